"""FASTQ and FASTA files: a batch source, formatting, and sinks."""

from __future__ import annotations

import gzip
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.scratch import materialize
from helixframe.sources import ranges

SCHEMA = "file string, ordinal long, id string, seq string, plus string, qual string, crlf boolean"
_FASTQ, _FASTA = (".fastq", ".fq"), (".fasta", ".fa", ".fna")


FormatError = ranges.FormatError


def is_gzip_name(path: str) -> bool:
    return path.lower().endswith(".gz")


def detect(path: str, head: list[str] = ()) -> str:
    """fastq or fasta: by the name's end (after .gz), else by the first lines that aren't empty."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(_FASTQ):
        return "fastq"
    if name.endswith(_FASTA):
        return "fasta"
    lines = [x for x in head if x.strip()][:3]
    if lines and lines[0].startswith(">"):
        return "fasta"
    if len(lines) >= 1 and lines[0].startswith("@"):
        return "fastq" if len(lines) < 3 or lines[2].startswith("+") else "fasta"
    raise FormatError(f"{path}: neither FASTQ nor FASTA")


def opened(content: bytes) -> bytes:
    """The content, inflated if it's gzip (any number of members); a stream that breaks off fails."""
    if content[:2] != b"\x1f\x8b":
        return content
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
            return f.read()
    except (EOFError, OSError, zlib.error) as e:
        raise FormatError(f"gzip: {e}") from None


def parse(content: bytes, form: str) -> Iterator[tuple[str, str, str | None, str | None, bool]]:
    """(id, seq, plus, qual, crlf) of each record: four lines of FASTQ, or a header and its lines of FASTA (headers may start with @)."""
    lines = content.decode("ascii", "surrogateescape").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    if form == "fasta":
        i = 0
        while i < len(lines):
            head = lines[i]
            if head[:1] not in (">", "@"):
                raise FormatError(f"line {i + 1} isn't a header")
            j = i + 1
            while j < len(lines) and lines[j][:1] not in (">", "@"):
                j += 1
            yield head.rstrip("\r"), "".join(x.rstrip("\r") for x in lines[i + 1 : j]), None, None, head.endswith("\r")
            i = j
        return
    if len(lines) % 4:
        raise FormatError(f"{len(lines)} lines are no whole number of records")
    for i in range(0, len(lines), 4):
        name, seq, plus, qual = (x.rstrip("\r") for x in lines[i : i + 4])
        if not name.startswith("@") or not plus.startswith("+") or len(seq) != len(qual):
            raise FormatError(f"record {i // 4 + 1}: no @, no +, or {len(qual)} qualities for {len(seq)} bases")
        yield name, seq, plus, qual, lines[i].endswith("\r")


def read(spark: SparkSession, path: str, form: str | None = None, across: bool = False, size: int = ranges.RANGE) -> DataFrame:
    """Records of all files of a path, with their places in their file, or, ``across`` all files, in the order of their names. Plain files and block gzip
    are read in ranges of ``size`` bytes by many tasks, and twice: once to count what begins in each range. A plain gzip file can't be cut: one task reads it, as a stream.
    ``form``: fastq or fasta (default: by name, else by the first lines). FASTQ records have four lines; FASTA ones a header, which may start with @, and any number."""

    def counted(row: dict, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        own = form or detect(row["file"], _head(f, row["kind"]))
        heads = (b">", b"@") if own == "fasta" else ()
        n = ranges.count_starts(ranges.text_of(f, row["kind"], row["start"], row["end"]), row["start"] == 0, heads)
        yield pa.RecordBatch.from_pylist([{**row, "form": own, "n": n}], schema=pa.schema([("file", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("form", pa.string()), ("n", pa.int64())]))

    cut = materialize(ranges.each(ranges.ranges(spark, path, size), "file string, kind string, length long, start long, end long, form string, n long", counted), "ranges")
    places = ranges.numbered(cut, False)
    if across:
        # the last, empty line that ends a file isn't one: whole records by file come first, then the files before
        per_file = cut.groupBy("file").agg(F.when(F.first("form") == "fasta", F.sum("n")).otherwise(F.floor(F.sum("n") / 4)).cast("long").alias("records"))
        files = per_file.select("file", F.coalesce(F.sum("records").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("shift"))
        places = places.join(files.hint("merge"), "file")
    else:
        places = places.withColumn("shift", F.lit(0).cast("long"))

    def records(row: dict, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        lines = ranges.lines_of(ranges.text_of(f, row["kind"], row["start"], row["end"]), row["start"] == 0)
        made = _fastq_batches if row["form"] == "fastq" else _fasta_batches
        yield from made(lines, row["file"], row["before"], row["n"], row["shift"])

    return ranges.each(places, SCHEMA, records)


def _head(f: pa.NativeFile, kind: str) -> list[str]:
    """The first lines of a file."""
    head = next((c for c, _ in ranges.text_of(f, kind, 0, 4096)), b"")
    f.seek(0)
    return head[:4096].decode("ascii", "replace").splitlines()


def _text(x: bytes) -> str:
    return x.decode("ascii", "surrogateescape").encode("utf-8", "replace").decode()


def _fastq_batches(lines: Iterator[list[bytes]], name: str, before: int, n: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Records that begin in lines before .. before + n - 1 of a file."""
    skip, left = -before % 4, (before + n + 3) // 4 - (before + 3) // 4
    place, held = (before + 3) // 4, []
    while left > 0:
        found = next(lines, None)
        if found is not None:
            drop = min(skip, len(found))
            skip -= drop
            held += found[drop:]
            if len(held) < 4 * min(left, 5000):
                continue
        elif not held or (held == [b""]):
            return
        whole = min(left, len(held) // 4)
        if found is None and len(held) % 4 and whole < left:
            raise FormatError("the lines are no whole number of records")
        rows = []
        for i in range(whole):
            own = held[4 * i : 4 * i + 4]
            rid, seq, plus, qual = (x.rstrip(b"\r") for x in own)
            if not rid.startswith(b"@") or not plus.startswith(b"+") or len(seq) != len(qual):
                raise FormatError(f"record {place + i + 1}: no @, no +, or {len(qual)} qualities for {len(seq)} bases")
            rows.append((name, place + i + shift, _text(rid), _text(seq), _text(plus), _text(qual), own[0].endswith(b"\r")))
        if rows:
            yield _batch(rows)
        held, place, left = held[4 * whole :], place + whole, left - whole
        if found is None:
            return


def _fasta_batches(lines: Iterator[list[bytes]], name: str, before: int, n: int, shift: int) -> Iterator[pa.RecordBatch]:
    """The n records whose headers stand in a range, of which ``before`` come before in the file."""
    rows: list[tuple] = []
    head, parts, done = None, [], 0

    def add() -> None:
        rows.append((name, before + done + shift, _text(head.rstrip(b"\r")), _text(b"".join(parts)), None, None, head.endswith(b"\r")))

    for found in lines:
        for line in found:
            if line[:1] in (b">", b"@"):
                if head is not None:
                    add()
                    done += 1
                if done == n:
                    head = None
                    break
                head, parts = line, []
            elif head is not None:
                parts.append(line.rstrip(b"\r"))
            elif not before and not done and n == 0 and line.strip():
                raise FormatError("the first line isn't a header")
        if len(rows) >= 5000 or (rows and done == n):
            yield _batch(rows)
            rows = []
        if done == n:
            return
    if head is not None:
        add()
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "ordinal", "id", "seq", "plus", "qual", "crlf"])


def fastq(id: Column, seq: Column, qual: Column, repeat_id: bool = False, crlf: bool = False) -> Column:
    """A FASTQ record without its last line end; qualities that were dropped are I."""
    eol = "\r\n" if crlf else "\n"
    plus = F.concat(F.lit("+"), F.substring(id, F.lit(2), F.length(id))) if repeat_id else F.lit("+")
    return F.concat(F.concat_ws(eol, id, seq, plus, F.coalesce(qual, F.repeat(F.lit("I"), F.length(seq)))), F.lit("\r" if crlf else ""))


def fasta(id: Column, seq: Column, crlf: bool = False) -> Column:
    eol = "\r\n" if crlf else "\n"
    return F.concat(F.concat_ws(eol, id, seq), F.lit("\r" if crlf else ""))


def write(records: DataFrame, path: str, compression: str = "none", level: int = 6, in_place: bool = False) -> None:
    """Writes one string column of formatted records, in order of ``ordinal``, as text files whose names sort in that order. ``compression``: none, gzip (Spark's
    codec) or bgzf (blocks, and the empty one that ends a file; files of this kind are named .txt as well, readers tell them by their first bytes); ``level``: 1 to 9.
    Tasks compress what they have; no file passes through the driver. ``in_place``: records that lie in few stretches of following places are not shuffled, each stretch becomes a file in a folder of its own."""
    if compression not in ("none", "gzip", "bgzf") or not 1 <= level <= 9:
        raise FormatError(f"compression {compression!r}, level {level}")
    if in_place and _few_stretches(records):
        _write_stretches(records, path, compression, level)
        return
    ordered = records.repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("record")
    if compression != "bgzf":
        ordered.write.option("compression", compression).option("zlib.compress.level", _LEVELS[level]).text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([bgzf(b"".join(held), level, end=False)], pa.binary())], names=["part"])
        for batch in batches:
            for r in batch.column(0).cast(pa.binary()).to_pylist():
                held.append((r or b"") + b"\n")
                size += len(held[-1])
                if size > 4 << 20:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    # the text writer ends each row, so each 4 MB of text, with the empty block that also ends a file
    packed = ordered.mapInArrow(run, "part binary").select(F.col("part").cast("string"))
    packed.write.option("lineSep", _END.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


#: Stretches are written where they lie if they are few, or this long in the mean.
_FEW, _LONG = 64, 50_000


def _cuts(places: np.ndarray, follows: int | None) -> list[int]:
    """Where stretches of following places begin in a batch; the first one may go on from the batch before."""
    return [*([] if follows == places[0] else [0]), *(np.flatnonzero(np.diff(places) != 1) + 1).tolist()]


def _few_stretches(records: DataFrame) -> bool:
    """Whether the places are unique and lie in few stretches; only places are read. A task with very many stretches stops counting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, rows, odd = [], [], 0, False
        for batch in batches:
            odd = odd or batch.column(0).null_count > 0 or len(begun) > 10_000
            if odd or not batch.num_rows:
                continue
            places = batch.column(0).to_numpy()
            rows += len(places)
            cuts = _cuts(places, last[-1] + 1 if last else None)
            if not cuts or cuts[0] > 0:
                last[-1] = int(places[(cuts[0] if cuts else len(places)) - 1])
            for i, j in zip(cuts, [*cuts[1:], len(places)], strict=False):
                begun.append(int(places[i])), last.append(int(places[j - 1]))
        if odd:  # as two that overlap
            begun, last = [0, 0], [0, 0]
        yield pa.RecordBatch.from_arrays([pa.array(begun, pa.int64()), pa.array(last, pa.int64()), pa.array([rows, *[0] * (len(begun) - 1)][: len(begun)], pa.int64())], names=["begun", "last", "rows"])

    found = records.select("ordinal").mapInArrow(run, "begun long, last long, rows long")
    apart = F.coalesce(F.lead("begun").over(Window.orderBy("begun", "last")) > F.col("last"), F.lit(True))  # a row for each stretch
    n, rows, unique = found.withColumn("apart", apart).agg(F.count("*"), F.sum("rows"), F.bool_and("apart")).first()
    return n > 0 and unique and (n <= _FEW or rows >= _LONG * n)


def _write_stretches(records: DataFrame, path: str, compression: str, level: int) -> None:
    """Each stretch of following places of a task as a file; folders are named by the first place, with as many digits for each. Text comes to the writer in pieces of a few MB."""
    most = 4 << 20 if compression == "bgzf" else 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, stretch, number, follows = [], 0, 0, 0, None

        def piece() -> pa.RecordBatch:
            text = b"\n".join(held)
            part = bgzf(text + b"\n", level, end=False) if compression == "bgzf" else text
            return pa.RecordBatch.from_arrays([pa.array([stretch + _FIRST]), pa.array([number]), pa.array([part], pa.binary())], names=["stretch", "number", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            places, texts = batch.column(0).to_numpy(), [r or b"" for r in batch.column(1).cast(pa.binary()).to_pylist()]
            begun = _cuts(places, follows)
            for i, j in zip([0, *[c for c in begun if c]], [*[c for c in begun if c], len(places)], strict=True):
                if i in begun:
                    if held:
                        yield piece()
                    held, size, stretch, number = [], 0, int(places[i]), 0
                held += texts[i:j]
                size += sum(map(len, texts[i:j]))
                if size > most:
                    yield piece()
                    held, size, number = [], 0, number + 1
            follows = int(places[-1]) + 1
        if held:
            yield piece()

    pieces = records.select("ordinal", "record").mapInArrow(run, "stretch long, number long, part binary")
    out = pieces.sortWithinPartitions("stretch", "number").select(F.col("part").cast("string").alias("part"), "stretch").write.partitionBy("stretch")
    if compression == "bgzf":
        out = out.option("lineSep", _END.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none")
    else:
        out = out.option("compression", compression).option("zlib.compress.level", _LEVELS[level])
    out.text(path)


#: Added to first places, so that their names sort like numbers.
_FIRST = 10**17


#: Names that Hadoop's codecs have for the levels (fixed values).
_LEVELS = dict(zip(range(1, 10), "BEST_SPEED TWO THREE FOUR FIVE SIX SEVEN EIGHT BEST_COMPRESSION".split(), strict=True))


def level_for(xfl: Column, default: int) -> Column:
    """The level that a gzip file's XFL byte speaks of: 2 is 8, 4 is 1 (fixed values), else the default."""
    return F.when(xfl == 2, 8).when(xfl == 4, 1).otherwise(default)


# -- block gzip --------------------------------------------------------------------------------------------

#: Most input bytes of a block, and the block that ends a file.
BLOCK = 0xFF00
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    """One member with its size in the BC field; data that doesn't get small enough is stored."""
    if len(data) > BLOCK:
        raise FormatError(f"a block of {len(data)} bytes")
    for own in (level, 0):
        z = zlib.compressobj(own, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        if len(body) + 26 <= 65536:
            break
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf(data: bytes, level: int = 6, end: bool = True) -> bytes:
    return b"".join(bgzf_block(data[i : i + BLOCK], level) for i in range(0, len(data), BLOCK)) + (_END if end else b"")


def bgzf_blocks(content: bytes) -> Iterator[tuple[int, int]]:
    """(offset, size) of each block: blocks are members of their own, so that tasks can inflate them apart."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != b"\x1f\x8b\x08\x04" or len(content) - at < 18:
            raise FormatError(f"no block at byte {at}")
        size = struct.unpack_from("<H", content, at + 16)[0] + 1
        if at + size > len(content):
            raise FormatError(f"the block at byte {at} is cut off")
        yield at, size
        at += size


gzip_header = ranges.header


def gzip_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, length and, for gzip, flg, mtime, xfl, os, name, block_size of the first member of each file; tasks read its first bytes."""
    schema = "file string, kind string, length long, flg int, mtime long, xfl int, os int, name string, block_size int"
    arrow = pa.schema([("file", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("flg", pa.int32()), ("mtime", pa.int64()), ("xfl", pa.int32()), ("os", pa.int32()), ("name", pa.string()), ("block_size", pa.int32())])

    def looked(row: dict, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        found = ranges.header(f.read(1 << 16)) or {}
        yield pa.RecordBatch.from_pylist([{k: {**found, **row}.get(k) for k in arrow.names}], schema=arrow)

    return ranges.each(ranges.ranges(spark, path).where("start = 0"), schema, looked)


def total_bytes(spark: SparkSession, path: str, size: int = ranges.RANGE) -> DataFrame:
    """For each file: its bytes, its members (blocks; null for plain gzip), and the bytes of its text. Blocks say theirs in their last bytes and are not inflated; plain
    gzip files are, each by one task, as a stream."""

    def measured(row: dict, f: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        members, text = None, row["end"] - row["start"]
        if row["kind"] == "bgzf":
            members = text = 0
            for at, block in ranges.blocks(f, row["start"]):
                if at >= row["end"]:
                    break
                members, text = members + 1, text + struct.unpack("<I", block[-4:])[0]
        elif row["kind"] == "gzip":
            text = sum(len(c) for c, _ in ranges.text_of(f, "gzip", 0, row["end"]))
        yield pa.RecordBatch.from_pylist([{"file": row["file"], "bytes": row["length"], "members": members, "text_bytes": text}], schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("members", pa.int64()), ("text_bytes", pa.int64())]))

    parts = ranges.each(ranges.ranges(spark, path, size), "file string, bytes long, members long, text_bytes long", measured)
    return parts.groupBy("file").agg(F.first("bytes").alias("bytes"), F.sum("members").alias("members"), F.sum("text_bytes").alias("text_bytes"))


#: Endings (fixed values) of the lanes in names of outputs.
_LANE_ENDINGS = {"R1", "R2", "R3", "I1", "I2"}


def with_role(name: str, role: str) -> str:
    """The name with a role in front of its first ending: a.fastq.gz becomes a.R1.fastq.gz."""
    folder, slash, own = name.rpartition("/")
    gz = own[-3:] if is_gzip_name(own) else ""
    stem, dot, end = own.removesuffix(gz).partition(".")
    return f"{folder}{slash}{stem}.{role}{dot}{end}{gz}"


def grouped_names(names: dict[str, str]) -> dict[str, str]:
    """Output names of lanes from their stored names: those that several lanes share get the lane in front of the ending, and a number behind it
    while another output has that name too."""
    out: dict[str, str] = {}
    for lane, name in names.items():
        if lane not in _LANE_ENDINGS:
            raise FormatError(f"no lane {lane!r}")
        own = with_role(name, lane) if sum(n == name for n in names.values()) > 1 else name
        turn = 2
        while own in out.values():
            own, turn = with_role(name, f"{lane}{turn}"), turn + 1
        out[lane] = own
    return out


def decompressed_names(archive: str, outputs: list[str], paired: bool, stored: list[str] = (), gzipped: list[bool] = (False, False), unzip: bool = False, fasta: bool = False) -> list[str]:
    """Output names of an archive: those given; a single one for pairs is a prefix; none: the stored names, else the archive's name. Names that are made here
    get .gz where the input had it, and lose it with ``unzip``."""
    base = archive.rsplit("/", 1)[-1].removesuffix(".sp")
    mates = 2 if paired else 1
    if len(outputs) == mates and not (paired and len(outputs) == 1):
        return list(outputs)
    if not outputs:
        made = [base + f".R{i + 1}" if paired else base + (".fasta" if fasta else ".fastq") for i in range(mates)]
        out = [s.rsplit("/", 1)[-1] or m for s, m in zip([*stored, *[""] * mates], made, strict=False)]
    elif paired and len(outputs) == 1:
        out = [f"{outputs[0]}.R{i + 1}" for i in range(2)]
    else:
        raise FormatError(f"{len(outputs)} outputs for {mates}")
    bare = [re.sub(r"\.gz$", "", o, flags=re.I) for o in out]
    return bare if unzip else [o if is_gzip_name(o) or not g else o + ".gz" for o, g in zip(out, gzipped, strict=False)]


def output_names(name: str, lanes: list[str], gzipped: bool) -> dict[str, str]:
    """A file name for each lane: the name itself for a single one, else with the lane before the ending."""
    base = re.sub(r"\.gz$", "", name, flags=re.I)
    tail = ".gz" if gzipped else ""
    if len(lanes) == 1:
        return {lanes[0]: base + tail}
    stem, dot, end = base.rpartition(".")
    return {lane: (f"{stem}.{lane}.{end}" if dot and end.lower() in ("fastq", "fq", "fasta", "fa", "fna") else f"{base}.{lane}") + tail for lane in lanes}


def check_outputs(inputs: list[str], outputs: list[str]) -> None:
    """Fails if outputs coincide, overwrite an input, or leave their folder."""
    if len(set(outputs)) < len(outputs) or set(outputs) & set(inputs):
        raise FormatError("outputs must differ from each other and from the inputs")
    if any(".." in re.split(r"[\\/]", o) for o in outputs):
        raise FormatError("an output leaves its folder")


def check_members(names: list[str]) -> None:
    """Fails if a name within an archive is absolute, has a drive, is empty or leaves its folder."""
    for n in names:
        if not n or re.match(r"[\\/]|[A-Za-z]:", n) or ".." in re.split(r"[\\/]", n):
            raise FormatError(f"member {n!r} leaves the archive")


def stream(spark: SparkSession, path: str, form: str = "fastq") -> DataFrame:
    """Records of files as they come into a folder (an extension of the batch source): file, ordinal, id, seq, plus, qual, crlf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, i, *r) for i, r in enumerate(parse(opened(content), form))]
                for a in range(0, len(rows), 20_000):
                    yield _batch(rows[a : a + 20_000])

    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "content").mapInArrow(run, SCHEMA)


def has_records(spark: SparkSession, path: str) -> bool:
    """Whether any file of a path has a line that isn't empty; an absent path has none."""
    try:
        lines = spark.read.text(path)
    except Exception as e:  # Spark's own class for an absent path differs between its clients
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return not lines.where(F.length(F.trim("value")) > 0).limit(1).isEmpty()
