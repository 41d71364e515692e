"""WARC archives in Zstandard: a writer with revisit records, and a reader that checks what it reads.

An archive is a ``.warc.zst`` stream: a skippable frame with the dictionary (magic 0x184D2A5D), then one frame
for each record. Spark's own text writer puts the frames into files, so archives can lie in any file system that
Spark writes to: its line separator is set to an empty skippable frame, which every Zstandard reader passes over."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.text import fresh
from helixframe.scratch import materialize, tables

DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528
#: An empty skippable frame; its bytes are all ASCII.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never stored as revisits.
LEAST_REVISIT = 100
#: Bytes and records at the head of an archive from which its dictionary is made, and the dictionary's size.
SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 512 << 10, 128, 16 << 10
LEVEL, DATE = 3, "1970-01-01T00:00:00Z"
#: Bytes of the records of an archive; a larger record makes one alone.
ARCHIVE_BYTES = 256 << 20


class WarcError(ValueError):
    """An archive that isn't what its headers say."""


# -- one record --------------------------------------------------------------------------------------------


def urn(key: int | None) -> str:
    return f"<urn:x-row:{'' if key is None else key}>"


def uri_text(uri: str) -> str:
    """A URI without the characters that a header line can't hold: percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record(key: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record, or a revisit of the record ``refers_to``, whose block is the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {uri_text(uri)}")
    if revisit:
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(raw: bytes, first: str, once: tuple[str, ...] | None = None) -> dict[str, str]:
    """Header fields by lower-case name, folded lines joined; a field that is there twice fails (where ``once`` is given: one of these with
    another value; of others the last counts)."""
    lines = re.sub("\r\n[ \t]+", " ", raw.decode("utf-8" if once is None else "latin-1")).split("\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"starts with {lines[0][:40]!r}, not {first}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header line: {line[:80]!r}")
        key, value = name.lower(), value.strip()
        if key in out and (once is None or (key in once and out[key] != value)):
            raise WarcError(f"header {name} is there twice")
        out[key] = value
    return out


def _number(text: str | None, what: str) -> int:
    if text is None or not text.isascii() or not text.isdigit():
        raise WarcError(f"{what} is {text!r}, not a number")
    return int(text)


def _key(text: str | None) -> int | None:
    """The key in a record id of this writer; None for any other id."""
    m = re.fullmatch(r"<urn:x-row:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def _uri(text: str, what: str) -> str:
    if not re.fullmatch(r"<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*>", text):
        raise WarcError(f"{what} {text[:80]!r} is no URI in angle brackets")
    return text


#: Digest algorithms that are checked: the length of the value in hex and in base 32.
DIGESTS = {"sha256": (64, 52), "sha1": (40, 32), "md5": (32, 26)}


def _check_digest(label: str, body: bytes | None, what: str) -> None:
    """Fails if a digest "algorithm:value" isn't well formed or, where there is a ``body``, not that of it. Algorithms that aren't in DIGESTS pass."""
    algorithm, colon, value = label.partition(":")
    sizes = DIGESTS.get(algorithm.lower())
    if not colon or (sizes and not (re.fullmatch(f"[0-9a-fA-F]{{{sizes[0]}}}", value) or re.fullmatch(f"[A-Z2-7]{{{sizes[1]}}}=*", value))):
        raise WarcError(f"{what} {label[:80]!r}")
    if sizes and body is not None:
        raw = hashlib.new(algorithm.lower(), body).digest()
        if value.lower() != raw.hex() and value.rstrip("=") != base64.b32encode(raw).decode().rstrip("="):
            raise WarcError(f"{what}: {len(body)} bytes have another one than {label[:80]}")


def parse(raw: bytes) -> dict:
    """The record in one frame, with every header and length checked. The payload of response, request and revisit records over HTTP is what follows
    the HTTP headers, that of all other types (warcinfo, resource, metadata, conversion, continuation) the block. Digests by the algorithms of DIGESTS are compared, but not those
    of payloads that are transfer-encoded or marked as truncated, which a reader doesn't have in the form that was digested."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of the headers")
    h = _headers(raw[:end], "WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise WarcError(f"no header {name}")
    if not re.fullmatch(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?", h["warc-date"]):
        raise WarcError(f"date {h['warc-date']!r}")
    record_id, kind = _uri(h["warc-record-id"], "record id"), h["warc-type"]
    size = _number(h["content-length"], "Content-Length")
    block, tail = raw[end + 4 : end + 4 + size], raw[end + 4 + size :]
    if len(block) != size or tail != b"\r\n\r\n":
        raise WarcError(f"the block has {len(raw) - end - 8} bytes; Content-Length is {size}")
    if "warc-block-digest" in h:
        _check_digest(h["warc-block-digest"], block, "block digest")
    payload: bytes | None = block
    length, whole = size, "warc-truncated" not in h
    if kind in ("response", "request", "revisit") and (kind != "revisit" or block) and h.get("content-type", "application/http").startswith("application/http"):
        body = block.find(b"\r\n\r\n")
        if body < 0:
            raise WarcError("no end of the HTTP headers")
        http = _headers(block[:body], "" if kind == "request" else "HTTP/", ("content-length",))
        payload = block[body + 4 :]
        length, coded = len(payload), "transfer-encoding" in http
        if "content-length" in http and not coded:
            length = _number(http["content-length"], "the HTTP Content-Length")
            if whole and kind != "revisit" and length != len(payload):
                raise WarcError(f"the payload has {len(payload)} bytes; the HTTP Content-Length is {length}")
        whole = whole and not coded
    refers_to = None
    if kind == "revisit":
        if "warc-profile" not in h or not {"warc-refers-to", "warc-refers-to-target-uri"} & set(h):
            raise WarcError("a revisit without profile or what it refers to")
        if h["warc-profile"] == PROFILE and (payload or "warc-payload-digest" not in h):
            raise WarcError("a revisit of an identical payload with a payload, or without its digest")
        refers_to, payload = _uri(h["warc-refers-to"], "what it refers to") if "warc-refers-to" in h else None, None
    digest = h.get("warc-payload-digest")
    if digest is not None:
        _check_digest(digest, payload if whole else None, "payload digest")
    if payload is not None and not (digest or "").startswith("sha256:"):
        digest = hashlib.sha256(payload).hexdigest()
    return {
        "key": _key(record_id), "uri": h.get("warc-target-uri"), "record_type": kind, "refers_to": _key(refers_to), "payload_bytes": length,
        "payload_digest": digest.removeprefix("sha256:") if digest else None, "payload": payload, "record_id": record_id, "refers_to_id": refers_to,
    }


# -- one archive -------------------------------------------------------------------------------------------


def train(samples: list[bytes]) -> bytes | None:
    """A dictionary from records at the head of an archive; None where they are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The archive of the records: the frame with the dictionary, if there is one, and a frame for each record."""
    held: list[bytes] = []
    size = 0
    compressor = None
    for r in records:
        if compressor is not None:
            yield compressor.compress(r)
            continue
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES or len(held) >= SAMPLE_RECORDS:
            compressor, first = _started(held)
            yield from first
            held = []
    if held:
        yield from _started(held)[1]


def archives(records: Iterator[bytes], most: int) -> Iterator[tuple[int, bytes]]:
    """(archive, frame): the records in archives of about ``most`` bytes of records at most, each with its own dictionary."""
    ahead, number = next(records, None), 0

    def some() -> Iterator[bytes]:
        nonlocal ahead
        size = 0
        while ahead is not None and (not size or size + len(ahead) <= most):
            one, ahead = ahead, next(records, None)
            size += len(one)
            yield one

    while ahead is not None:
        for f in frames(some()):
            yield number, f
        number += 1


def _started(held: list[bytes]) -> tuple[zstandard.ZstdCompressor, list[bytes]]:
    dictionary = train([r[: 16 << 10] for r in held])
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    out = [compressor.compress(r) for r in held]
    if dictionary:
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
        out.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    return compressor, out


def records(archive: bytes) -> Iterator[bytes]:
    """The contents of an archive's frames. The dictionary is taken from the leading skippable frame; other skippable
    frames are passed over. A frame's end is found from its block headers, so that each is decoded on its own."""
    data, at, n = memoryview(archive), 0, len(archive)
    reader = zstandard.ZstdDecompressor()
    while at < n:
        if n - at < 8:
            raise WarcError(f"{n - at} bytes are left over")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if n - at - 8 < size:
                raise WarcError("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise WarcError("the dictionary isn't at the head of the archive")
                held = bytes(data[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = zstandard.ZstdDecompressor().decompress(held)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame starts at byte {at}")
        end = _frame_end(data, at)
        try:
            yield reader.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at}: {e}") from None
        at = end


def _frame_end(data: memoryview, at: int) -> int:
    head = bytes(data[at : at + 18])
    try:
        known, end = zstandard.get_frame_parameters(head), at + zstandard.frame_header_size(head)
    except zstandard.ZstdError as e:
        raise WarcError(f"the frame header at byte {at}: {e}") from None
    last = False
    while not last:
        if end + 3 > len(data):
            raise WarcError(f"the frame at byte {at} is cut off")
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = block & 1, (block >> 1) & 3, block >> 3
        if kind == 3:
            raise WarcError(f"the frame at byte {at} has a reserved block type")
        end += 3 + (1 if kind == 1 else size)
    end += 4 * known.has_checksum
    if end > len(data):
        raise WarcError(f"the frame at byte {at} is cut off")
    return end


# -- tables ------------------------------------------------------------------------------------------------


def with_revisits(rows: DataFrame, keep=materialize) -> DataFrame:
    """The rows (key, payload and any others) with digest (bare lower-case hex SHA-256 of payload) and refers_to: the smallest key of the rows with an
    equal payload of LEAST_REVISIT bytes or more, null for that row itself; columns of these names are replaced. Smaller payloads pass by the join. Keys are summed up
    and written (by ``keep``) before it: its two sides are plain shuffles then, in which adaptive execution splits a payload that many rows share."""
    others = [c for c in rows.columns if c not in ("digest", "refers_to")]
    least, own = fresh(rows, "least", "own")
    rows = rows.select(*[f"`{c}`" for c in others], F.sha2("payload", 256).alias("digest"))
    long = F.octet_length("payload") >= LEAST_REVISIT
    first = rows.where(long).groupBy("digest").agg(F.min("key").alias(least), F.count("*").alias(own)).where(F.col(own) > 1).drop(own)
    met = rows.where(long).join(keep(first, "payloads").hint("merge"), "digest", "left")
    met = met.select(*[f"`{c}`" for c in others], "digest", F.when(~F.col(least).eqNullSafe(F.col("key")), F.col(least)).alias("refers_to"))
    return met.unionByName(rows.where(~F.coalesce(long, F.lit(False))).withColumn("refers_to", F.lit(None).cast(rows.schema["key"].dataType)))


def write(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes the rows key (long), uri (string), payload (binary) as archives of about ``archive_bytes`` bytes of records into the folder ``path``.

    Null payloads are empty ones, null keys and uris stay null; other columns are left out. Rows that share key and payload are all responses, as
    each of them is the first. An empty table gives a folder without records."""
    with tables(rows.sparkSession, "warc") as keep:
        _write(with_revisits(rows.select(F.col("key").cast("long"), F.col("uri").cast("string"), F.coalesce("payload", F.lit(b"")).alias("payload")), keep), path, archive_bytes)


def _write(ready: DataFrame, path: str, archive_bytes: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    key, uri, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                    yield record(key, uri, payload, digest, refers_to)

        def batch_of(numbers: list[int], out: list[bytes], place: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(range(place, place + len(out)), pa.int64()), pa.array(out, pa.binary())], names=["archive", "place", "frame"])

        numbers: list[int] = []
        out: list[bytes] = []
        size = place = 0
        for number, f in archives(made(), archive_bytes):
            numbers.append(number)
            out.append(f)
            size += len(f)
            if size > 4 << 20:
                yield batch_of(numbers, out, place)
                place, numbers, out, size = place + len(out), [], [], 0
        if out:
            yield batch_of(numbers, out, place)

    framed = ready.select("key", "uri", "payload", "digest", "refers_to").mapInArrow(run, "archive int, place long, frame binary")
    # a folder for each number of an archive within its task; frames stay in their order
    ordered = framed.sortWithinPartitions("archive", "place").select("archive", F.col("frame").cast("string"))
    ordered.write.partitionBy("archive").option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, whoever wrote them: key and refers_to (numbers that ``write`` gave; null in archives of others), uri,
    record_type, payload_bytes, payload_digest (bare SHA-256 in hex where there is a payload), payload (null for revisits), record_id, refers_to_id. An archive that
    isn't sound fails with its path. One task reads an archive as a whole, so each must be smaller than 2 GB, as those of ``write`` are."""
    schema = "key long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string, refers_to_id string"
    arrow = pa.schema([("key", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("record_id", pa.string()), ("refers_to_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, size = [], 0
                try:
                    for raw in records(content):
                        rows.append(parse(raw))
                        size += len(raw)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                except (WarcError, UnicodeDecodeError) as e:
                    raise WarcError(f"{name}: {e}") from None
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)


def payload_of(text: str) -> Column:
    """A string column as UTF-8 bytes."""
    return F.col(text).cast("string").cast("binary")
