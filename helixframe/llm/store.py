"""A content-addressed store of token ids.

Each document's ids are cut where a rolling hash of the last ids has its low bits at zero, so equal passages give
equal chunks wherever they stand. A chunk is named by the SHA-256 of its bytes and stored once, in the pack row
of the first document that has it; a recipe lists a document's chunks, and for chunks that lie elsewhere the pack they
lie in. Merkle roots of documents, of pack files and of the whole store are kept in a manifest, and reading checks
every chunk and root. Chunks hold ids of 16 bits, or of 32 bits where an id is over 65535, byte plane by byte plane, and lie in one Zstandard frame for each document."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.text import _CLASSES, Known, grams, hash_codes, mix, slices, tidy
from helixframe.scratch import materialize, remove, scratch_path

#: Ids in the rolling window; a cut follows an id where so many low bits of the hash are zero; least and most ids of a chunk.
ROLL, BITS, LEAST, MOST = 8, 9, 64, 4096
#: Encoded parts that a task keeps, about: some 40 bytes each.
KEPT = 1_000_000


class StoreError(ValueError):
    """A store whose content doesn't give its digests."""


# -- ids, chunks, roots ------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes as, by byte: those that show something in Latin-1 as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


_BYTE_LETTERS = _byte_letters()
#: Code points below this one may be plain: classes of them (0: white space, 1: letter, 2: digit, 3: any other, 9: not plain), and their lower case.
_PLAIN = 0x20B0
_CODE_CLASS = np.full(_PLAIN + 1, 9, np.uint8)
_CODE_CLASS[:0x250] = [1 if re.match(f"[{_CLASSES[chr(92) + 'p{L}']}]", chr(i)) else 2 if re.match(f"[{_CLASSES[chr(92) + 'p{N}']}]", chr(i)) else 0 if re.match(f"[{_CLASSES[chr(92) + 's']}]", chr(i)) else 3 for i in range(0x250)]
_CODE_CLASS[0x130] = 9  # two characters in lower case
for _a, _b in ((0x2010, 0x2028), (0x2030, 0x203B), (0x20AC, 0x20AD)):  # dashes, quotes, dots; the euro sign
    _CODE_CLASS[_a:_b] = 3
_LOWER = np.arange(_PLAIN + 1, dtype=np.uint32)
_LOWER[:0x250] = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x250))]
_SHORT, _LONG = [ord(c) for c in "stmd"], {"r": "e", "v": "e", "l": "l"}


def split_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of texts in the tokenizer's sense, in lower case: 's 't 're 've 'm 'll 'd where one starts, runs of letters, single digits,
    runs of what is neither these nor white space. Returns the code points of all texts, the starts and ends of their parts, the text of each
    part, and which texts aren't plain: these have no parts."""
    joined = " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes = np.minimum(codes, np.uint32(_PLAIN))
    kind = _CODE_CLASS[codes]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(first, np.flatnonzero(kind == 9), side="right") - 1] = True
    tags = np.flatnonzero((codes[:-1] == 60) & (codes[1:] == 124))  # <| may start the name of a special token
    odd[np.searchsorted(first, tags, side="right") - 1] = True
    if odd.any():
        kind = np.where(np.repeat(odd, lengths), 0, kind)
    codes = _LOWER[codes]
    edge = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
    starts = np.flatnonzero(edge & (kind != 0))
    ends = np.flatnonzero(np.concatenate([edge[1:], [True]]) & (kind != 0)) + 1
    single = np.flatnonzero((codes[starts] == 39) & (ends == starts + 1))
    single = single[(kind[ends[single]] == 1)]
    if len(single):  # an apostrophe alone before a letter
        a, b = codes[ends[single]], codes[np.minimum(ends[single] + 1, len(codes) - 1)]
        more = np.isin(a, _SHORT).astype(np.int64)
        for x, y in _LONG.items():
            more[(a == ord(x)) & (b == ord(y))] = 2
        ends[single] += more
        starts[single[more > 0] + 1] += more[more > 0]
        left = starts < ends
        starts, ends = starts[left], ends[left]
    return codes, starts, ends, np.searchsorted(first, starts, side="right") - 1, odd


class WordIds:
    """Ids of texts by a tokenizer of the tokenizers library that lower-cases, drops white space and keeps letters, digits and
    the rest apart. No token passes over a bound between such parts, so a text's ids are those of its parts, one
    after another: parts are found and told apart by hashes in numpy, and each distinct one goes to the library's model once while it is
    kept. Texts with characters beyond Latin ones, where normal forms matter, and texts that may name a special token go to the library whole."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        self.known = Known(np.uint32, KEPT)

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[t.id for t in self.model.tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(_BYTE_LETTERS))] for p in parts]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def batch(self, texts: list[bytes], end: int | None) -> list[np.ndarray]:
        """The ids of each text, with the id ``end`` behind."""
        strings = [t.decode() for t in texts]
        codes, starts, ends, doc, odd = split_parts(strings)
        keys, checks = hash_codes(codes, starts, ends)

        def make(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            text = codes.tobytes().decode("utf-32-le")
            return self._learn([text[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])

        flat, lengths = self.known.lists.gather(at) if len(at := self.known.numbers(keys, checks, make)) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        before = np.concatenate([[0], np.cumsum(lengths)])
        bounds = before[np.searchsorted(doc, np.arange(len(texts) + 1))].tolist()
        tail = np.array([] if end is None else [end], "<u4")
        out = [np.concatenate([flat[a:b], tail]) for a, b in zip(bounds, bounds[1:], strict=False)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.concatenate([np.array(self.tokenizer.encode(strings[i], add_special_tokens=False).ids, "<u4"), tail])
        return out


_TOKENIZERS: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, one for each process; what has been encoded isn't kept with it."""
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cuts(streams: list[np.ndarray], roll: int = ROLL, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each id stream. The rolling hash runs over all streams at once: no cut is nearer to a stream's start
    than ``least`` ids, which the hash doesn't reach over."""
    if not 0 < roll <= least <= most:
        raise ValueError("it takes 0 < roll <= least <= most")
    flat = np.concatenate(streams).astype(np.uint64) if streams else np.zeros(0, np.uint64)
    marks = np.flatnonzero(grams(mix(flat + np.uint64(1)), roll) & np.uint64((1 << bits) - 1) == 0) + roll
    ends = np.cumsum([0, *map(len, streams)])
    first = np.searchsorted(marks, ends, side="right")
    out = []
    for i, x in enumerate(streams):
        own, last = [], 0
        for m in [*(marks[first[i] : first[i + 1]] - ends[i]).tolist(), len(x)]:
            while m - last > most:
                last += most
                own.append(last)
            if m - last >= least or (m == len(x) and m > last):
                own.append(m)
                last = m
        out.append(own)
    return out


def pack(ids: np.ndarray) -> bytes:
    """A byte 2 or 4, the bytes of an id; then the lowest bytes of all ids, the next bytes of all, and so on."""
    width = 2 if len(ids) == 0 or ids.max() < 65536 else 4
    return bytes([width]) + ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(chunk: bytes) -> np.ndarray:
    if chunk[:1] not in (b"\2", b"\4") or (len(chunk) - 1) % chunk[0]:
        raise StoreError(f"a chunk of {len(chunk)} bytes starts with {chunk[:1]!r}")
    planes = np.frombuffer(chunk, np.uint8, offset=1).reshape(chunk[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{chunk[0]}").ravel().astype("<u4")


def opened(frame: bytes) -> bytes:
    try:
        return zstandard.ZstdDecompressor().decompress(frame)
    except zstandard.ZstdError as e:
        raise StoreError(f"a chunk's frame: {e}") from None


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and inner nodes are hashed apart, an odd node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# -- writing -----------------------------------------------------------------------------------------------

_STAGED = "doc_id long, uid long, n_tokens long, root binary, digests array<binary>, sizes array<int>, data binary"
_PACKED = "doc_id long, part int, start_in_part long, n_tokens long, root binary, digests array<binary>, owners array<long>, own array<struct<seq:int,shared:boolean,size:int>>, data binary"
#: Rows that are held as Python objects at once.
ROWS = 256


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, a few of them as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, ROWS).columns), strict=True)


def _staged(df: DataFrame, tokenizer: str, end: int | None, text: str) -> DataFrame:
    """Each document's chunks: their digests and sizes, and one frame with all of them. uid: the head of the root, which orders documents that share a
    doc_id, and behind it a number for each row, which tells these apart."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = word_ids(tokenizer), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part, texts in slices(batch, "text", 1 << 20):
                rows: tuple[list, ...] = ([], [], [], [], [])
                streams = own.batch([t or b"" for t in texts], end)
                for ids, ends in zip(streams, cuts(streams), strict=True):
                    chunks = [pack(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
                    digests = [hashlib.sha256(c).digest() for c in chunks]
                    for column, value in zip(rows, (len(ids), merkle(digests), digests, [*map(len, chunks)], press(b"".join(chunks))), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=["doc_id", "uid", "n_tokens", "root", "digests", "sizes", "data"])

    numbered = df.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("uid"), F.col(text).cast("string").alias("text"))
    return numbered.mapInArrow(run, _STAGED)


def _parted(data: bytes, sizes: list[int]) -> list[bytes]:
    """The chunks of a frame."""
    raw = opened(data)
    if len(raw) != sum(sizes):
        raise StoreError(f"a frame holds {len(raw)} bytes; its recipe says {sum(sizes)}")
    ends = np.cumsum([0, *sizes]).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition in order of (doc_id, head, uid, kind): what is known of a document's shared chunks, then the document."""
    part, start = TaskContext.get().partitionId(), 0
    key, known = None, {}
    press = zstandard.ZstdCompressor(level=3).compress
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("owners", pa.list_(pa.int64())), ("own", pa.list_(pa.struct([("seq", pa.int32()), ("shared", pa.bool_()), ("size", pa.int32())]))), ("data", pa.binary())])
    out, size = [], 0
    for doc_id, uid, kind, shared, n_tokens, root, digests, sizes, data in _rows(batches):
        if uid != key:
            key, known = uid, {}
        if kind == 0:
            known = {x["digest"]: x for x in shared}
            continue
        own, owners, seen = [], [], set()
        for seq, digest in enumerate(digests):
            x = known.get(digest)
            mine = x is None or x["mine"]
            owners.append(None if mine else x["owner"])
            if mine and digest not in seen:
                seen.add(digest)
                own.append((seq, x is not None, sizes[seq]))
        if len(own) < len(digests):
            chunks = _parted(data, sizes)
            data = press(b"".join(chunks[x[0]] for x in own))
        out.append((doc_id, part, start, n_tokens, root, digests, owners, own, data))
        start += n_tokens
        size += len(data)
        if size > 4 << 20 or len(out) >= 2048:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def write(df: DataFrame, path: str, tokenizer: str, end: int | None = None, text: str = "text") -> None:
    """Encodes the whole texts with the tokenizer (a file of the tokenizers library; no special tokens are added), appends
    the id ``end``, and writes the store in ascending order of doc_id into the folder ``path``: packs, and a manifest.

    A null text is an empty one; a null doc_id comes first; rows that repeat a doc_id stay, each a document, in the order
    of their roots' heads. Other columns are left out. Only digests are shuffled to find equal chunks; ids are shuffled once, into their
    order. The owners of shared chunks are written before their join, so that adaptive execution can split a chunk that many documents have."""
    spark = df.sparkSession
    staging = scratch_path(spark, "store-staging")
    _staged(df, tokenizer, end, text).write.option("compression", "zstd").parquet(staging)
    staged = spark.read.schema(_STAGED).parquet(staging).withColumn("head", F.substring("root", 1, 8))
    order = ["doc_id", "head", "uid"]
    # a chunk belongs to the first document that has it; only chunks in several documents are told to these
    each = staged.select(*order, F.explode(F.array_distinct("digests")).alias("digest"))
    owner = each.groupBy("digest").agg(F.min(F.struct(*order)).alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("owner.doc_id").alias("owner"), F.col("owner.uid").alias("owner_uid"))
    owner = materialize(owner, "store-owners")
    told = each.join(owner.hint("merge"), "digest")
    told = told.groupBy(*order).agg(F.collect_list(F.struct("digest", (F.col("owner_uid") == F.col("uid")).alias("mine"), "owner")).alias("shared"))
    rows = told.withColumn("kind", F.lit(0)).unionByName(staged.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    ordered.select("doc_id", "uid", "kind", "shared", "n_tokens", "root", "digests", "sizes", "data").mapInArrow(tidy(_packer), _PACKED).write.option("compression", "zstd").parquet(f"{path}/packs")
    remove(spark, staging)
    _part_roots(spark, path).write.parquet(f"{path}/manifest")


def _part_roots(spark: SparkSession, path: str) -> DataFrame:
    """A row for each pack file: part, first_doc, n_docs, n_tokens, root over its documents' roots in their order. A task
    holds the roots of one pack file, whose size a shuffle partition bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for part, doc, tokens, root, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = parts.setdefault(part, [[], 0])
                p[0].append((start, hashlib.sha256(json.dumps([doc, tokens]).encode() + root).digest(), doc))
                p[1] += tokens
        for part, (docs, tokens) in parts.items():
            docs.sort(key=lambda d: d[0])
            yield pa.RecordBatch.from_pylist([{"part": part, "first_start": docs[0][0], "first_doc": docs[0][2], "n_docs": len(docs), "n_tokens": tokens, "leaves": [d[1] for d in docs]}], schema=pieces)

    pieces = pa.schema([("part", pa.int32()), ("first_start", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("leaves", pa.list_(pa.binary()))])
    found = spark.read.schema(_PACKED).parquet(f"{path}/packs").select("part", "doc_id", "n_tokens", "root", "start_in_part").mapInArrow(run, "part int, first_start long, first_doc long, n_docs long, n_tokens long, leaves array<binary>")
    # a large file may have been read by several tasks: its pieces meet by part

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["first_start"])
        root = merkle([x for r in rows for x in r["leaves"]])
        return pa.table({"part": [rows[0]["part"]], "first_doc": pa.array([rows[0]["first_doc"]], pa.int64()), "n_docs": [sum(r["n_docs"] for r in rows)], "n_tokens": [sum(r["n_tokens"] for r in rows)], "root": [root]}, schema=pa.schema([("part", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]))

    return found.groupBy("part").applyInArrow(join, "part int, first_doc long, n_docs long, n_tokens long, root binary")


# -- reading -----------------------------------------------------------------------------------------------


def check(spark: SparkSession, path: str) -> tuple[list, bytes]:
    """Makes the roots of all pack files anew and compares them with the manifest; returns its rows in order of their
    documents (one for each file) and the root over all."""
    stored = {r["part"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    found = {r["part"]: r for r in _part_roots(spark, path).collect()}
    if stored != found:
        odd = sorted(p for p in stored.keys() | found.keys() if stored.get(p) != found.get(p))
        raise StoreError(f"pack files that don't give their manifest: parts {odd[:20]}")
    rows = sorted(stored.values(), key=lambda r: (r["first_doc"] is not None, r["first_doc"] or 0, r["part"]))
    return rows, merkle([bytes(r["root"]) for r in rows])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store whose manifest holds: doc_id, start (ids of all documents before it), n_tokens, ids (binary,
    little-endian 32 bits). Every chunk is checked against its digest and every document against its root. Only
    documents with chunks in other packs, and these chunks, are shuffled."""
    rows, _ = check(spark, path)
    offsets, total = {}, 0
    for r in rows:
        offsets[r["part"]] = total
        total += r["n_tokens"]
    packs = spark.read.schema(_PACKED).parquet(f"{path}/packs")
    away = F.exists("owners", lambda o: o.isNotNull())
    wanted = packs.where(away).select("part", "start_in_part", F.explode(F.array_distinct(F.expr("filter(digests, (d, i) -> owners[i] is not null)"))).alias("digest"))

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for digests, own, data in _rows(batches):
            held += [(digests[x["seq"]], c) for x, c in zip(own, _parted(data, [x["size"] for x in own]), strict=True) if x["shared"]]
            size += len(data)
            if size > 4 << 20 or len(held) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*held, strict=True)], names=["digest", "data"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*held, strict=True)], names=["digest", "data"])

    # a chunk is stored once, so that nothing has to be summed up before the join, which adaptive execution can split
    shared = packs.where(F.exists("own", lambda c: c["shared"])).select("digests", "own", "data").mapInArrow(lend, "digest binary, data binary")
    keys = ["part", "start_in_part"]
    brought = wanted.join(shared.hint("merge"), "digest").groupBy(*keys).agg(F.collect_list(F.struct("digest", "data")).alias("brought"))
    far = packs.where(away).join(brought.hint("merge"), keys, "left")
    near = packs.where(~away).withColumn("brought", F.lit(None).cast("array<struct<digest:binary,data:binary>>"))
    columns = ["doc_id", "part", "start_in_part", "n_tokens", "root", "digests", "own", "data", "brought"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for doc_id, part, start_in_part, n_tokens, root, digests, own, data, brought in _rows(batches):
            chunks = {digests[x["seq"]]: c for x, c in zip(own, _parted(data, [x["size"] for x in own]), strict=True)}
            chunks |= {x["digest"]: x["data"] for x in brought or []}
            for digest, chunk in chunks.items():
                if hashlib.sha256(chunk).digest() != digest:
                    raise StoreError(f"document {doc_id}: a chunk has another digest than {digest.hex()}")
            if missing := [d for d in digests if d not in chunks]:
                raise StoreError(f"document {doc_id}: no chunk {missing[0].hex()}")
            if merkle(digests) != root:
                raise StoreError(f"document {doc_id}: its chunks don't give its root")
            ids = np.concatenate([unpack(chunks[d]) for d in digests]) if digests else np.zeros(0, "<u4")
            if len(ids) != n_tokens:
                raise StoreError(f"document {doc_id} has {len(ids)} ids; its recipe says {n_tokens}")
            out.append((doc_id, offsets[part] + start_in_part, len(ids), ids.tobytes()))
            size += 4 * len(ids)
            if size > 4 << 20 or len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), made.types, strict=True)], schema=made)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), made.types, strict=True)], schema=made)

    made = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    schema = "doc_id long, start long, n_tokens long, ids binary"
    return near.select(*columns).mapInArrow(run, schema).unionByName(far.select(*columns).mapInArrow(run, schema))
