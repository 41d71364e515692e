"""Text files in byte ranges: plain files and block gzip are cut, so that tasks read them apart; a plain gzip file is one range, read as a stream.

Ranges are rows (file, kind, start, end). A range has the lines that begin behind one of its line ends; a file's first line is its first range's.
Reading goes on beyond the range until what began in it is whole. Files are opened through Arrow's file systems."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range; bytes read at once; most bytes of a block of block gzip.
RANGE, CHUNK, MOST_BLOCK = 64 << 20, 1 << 20, 1 << 16
_MAGIC = b"\x1f\x8b\x08\x04"


class FormatError(ValueError):
    pass


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place. ``path`` is one as Spark gives it."""
    if re.match(r"file:|/", path):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", path))
    try:
        system, own = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise FormatError(f"{path}: Arrow has no file system for it: {e}") from None
    return system.open_input_file(own)


def header(content: bytes) -> dict | None:
    """flg, mtime, xfl, os, name, bgzf, block_size of a first gzip member; None if it isn't gzip."""
    if content[:3] != b"\x1f\x8b\x08" or len(content) < 10:
        return None
    flg, mtime, xfl, os = struct.unpack_from("<BIBB", content, 3)
    at, block = 10, None
    if flg & 4 and len(content) >= 12:
        n = struct.unpack_from("<H", content, at)[0]
        extra = content[at + 2 : at + 2 + n]
        if extra[:2] == b"BC" and len(extra) >= 6:
            block = struct.unpack_from("<H", extra, 4)[0]
        at += 2 + n
    name = ""
    if flg & 8:
        end = content.find(b"\0", at)
        name = content[at:end].decode("latin-1") if end >= 0 else ""
    return {"flg": flg, "mtime": mtime, "xfl": xfl, "os": os, "name": name, "bgzf": block is not None, "block_size": block}


def kind_of(content: bytes) -> str:
    """plain, gzip or bgzf, by a file's first bytes."""
    found = header(content)
    return "plain" if found is None else "bgzf" if found["bgzf"] else "gzip"


# -- reading -----------------------------------------------------------------------------------------------


def blocks(f: pa.NativeFile, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each block of block gzip that begins at ``start`` or behind it."""
    end = f.size()
    at = start
    if start:  # the next place that looks like a block and has another one, or the end, behind it
        f.seek(start)
        near = f.read(3 * MOST_BLOCK)
        i = near.find(_MAGIC)
        while i >= 0:
            size = (header(near[i : i + 64]) or {}).get("block_size")
            if size is not None and (start + i + size + 1 == end or near[i + size + 1 :][:4] == _MAGIC):
                break
            i = near.find(_MAGIC, i + 1)
        if i < 0:
            if start + len(near) < end:
                raise FormatError(f"no block at byte {start} or soon behind it")
            return
        at = start + i
    f.seek(at)
    while at < end:
        head = f.read(18)
        size = (header(head) or {}).get("block_size")
        if size is None or len(head) < 18 or at + size + 1 > end:
            raise FormatError(f"no whole block at byte {at}")
        yield at, head + f.read(size + 1 - 18)
        at += size + 1


def inflated(block: bytes) -> bytes:
    crc, size = struct.unpack("<II", block[-8:])
    try:
        out = zlib.decompress(block[12 + struct.unpack_from("<H", block, 10)[0] : -8], -15)
    except zlib.error as e:
        raise FormatError(f"a block: {e}") from None
    if len(out) != size or zlib.crc32(out) != crc:
        raise FormatError("a block has another size or checksum than it says")
    return out


def _inflated_stream(f: pa.NativeFile) -> Iterator[bytes]:
    """The text of a gzip file of any number of members, a chunk at a time; one that breaks off fails."""
    z, data = zlib.decompressobj(31), b""
    begun = False
    while True:
        if not data:
            data = f.read(CHUNK)
            if not data:
                break
        try:
            out = z.decompress(data, 4 * CHUNK)
        except zlib.error as e:
            raise FormatError(f"gzip: {e}") from None
        begun = True
        data = z.unconsumed_tail
        if out:
            yield out
        if z.eof:
            data, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        raise FormatError("gzip: the file breaks off")


def text_of(f: pa.NativeFile, kind: str, start: int, end: int) -> Iterator[tuple[bytes, bool]]:
    """The text from a range on, in chunks, each with whether it's the range's own."""
    if kind == "gzip":
        yield from ((c, True) for c in _inflated_stream(f))
    elif kind == "bgzf":
        yield from ((inflated(b), at < end) for at, b in blocks(f, start))
    else:
        f.seek(start)
        while data := f.read(min(CHUNK, end - start) if start < end else CHUNK):
            yield data, start < end
            start += len(data)


def count_starts(chunks: Iterator[tuple[bytes, bool]], first: bool, heads: tuple[bytes, ...] = ()) -> int:
    """How many lines begin in a range, the last one too if it's empty; of these, with ``heads``, those that begin with one of them."""
    n, behind = 0, first  # behind: whether the next byte begins a line
    for data, own in chunks:
        if not own:
            return n + (behind and (not heads or data[:1] in heads))
        if not heads:
            n += data.count(b"\n")
        else:
            n += (behind and data[:1] in heads) + sum(data.count(b"\n" + h) for h in heads)
            behind = data[-1:] == b"\n" if data else behind
    return n + (first and not heads)


def lines_of(chunks: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[list[bytes]]:
    """The lines from the first one that begins in a range on, in lists, to the end of the file."""
    rest, skip = b"", not first
    for data, _ in chunks:
        if skip:
            i = data.find(b"\n")
            if i < 0:
                continue
            data, skip = data[i + 1 :], False
        found = (rest + data).split(b"\n")
        rest = found.pop()
        if found:
            yield found
    if rest:
        yield [rest]


# -- ranges as rows ------------------------------------------------------------------------------------------


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """file, kind, length, start, end: the ranges of all files of a path. Spark lists the files; tasks look at their first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for p in batch.column(0).to_pylist():
                with opened(p) as f:
                    kinds.append(kind_of(f.read(64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds), batch.column(1)], names=["file", "kind", "length"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    files = files.mapInArrow(run, "file string, kind string, length long")
    starts = F.when(F.col("kind") == "gzip", F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    cut = files.select("file", "kind", "length", F.explode(starts).alias("start"))
    last = F.when(F.col("kind") == "gzip", F.col("length")).otherwise(F.least(F.col("start") + size, F.col("length")))
    return cut.withColumn("end", last)


def each(cut: DataFrame, schema: str, work) -> DataFrame:
    """``work(row, file)`` gives record batches for each range; ranges are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["file"]) as f:
                    try:
                        yield from work(row, f)
                    except FormatError as e:
                        raise FormatError(f"{row['file']}: {e}") from None

    return dealt(cut).mapInArrow(run, schema)


def dealt(cut: DataFrame) -> DataFrame:
    """Ranges dealt out by their bytes, in the order of files, to as many tasks as Spark shuffles to. Adaptive execution keeps this number; it would join tasks by the bytes of
    their rows, which say nothing about the work. A row for each range is ordered in one task."""
    n = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = F.sum(F.col("end") - F.col("start")).over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, 0))
    all_of = F.sum(F.col("end") - F.col("start")).over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    middle = F.col("__upto") - (F.col("end") - F.col("start")) / 2
    placed = cut.withColumns({"__upto": upto, "__all": all_of}).withColumn("__task", F.least(F.floor(middle * n / F.col("__all")), F.lit(n - 1)).cast("int"))
    return placed.repartitionById(n, "__task").drop("__upto", "__all", "__task")


def numbered(counted: DataFrame, across: bool) -> DataFrame:
    """Adds ``before``: the sum of n of the ranges before, within the file or, ``across`` all, in the order of their names. A row for each range."""
    order = (Window.orderBy("file", "start") if across else Window.partitionBy("file").orderBy("start")).rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long"))
