"""Column functions on read names."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def synthetic(ordinal: Column, mate: int) -> Column:
    return F.concat(F.lit("@"), (ordinal + 1).cast("string"), F.lit(f"/{mate}"))


def tokens(name: Column) -> Column:
    """Runs of letters and digits, and the runs between them, in order."""
    return F.regexp_extract_all(name, F.lit("([0-9A-Za-z]+|[^0-9A-Za-z]+)"), F.lit(1))


def joined(parts: Column) -> Column:
    """The inverse of ``tokens``."""
    return F.array_join(parts, "")


def numeric(token: Column) -> Column:
    """The number that a token of at most 9 digits without a leading zero is, else null."""
    return F.when(F.rlike(token, F.lit("^(0|[1-9][0-9]{0,8})$")), token.try_cast("bigint"))


#: Rows of a block of coded names.
NAME_BLOCK = 10_000


_TOKEN = re.compile("[0-9A-Za-z]+|[^0-9A-Za-z]+")


def _number(token: str) -> int | None:
    """As ``numeric``."""
    return int(token) if token.isascii() and token.isdigit() and len(token) < 10 and (token[0] != "0" or token == "0") else None


def _codes(name: str, before: dict[int, str]) -> list[str]:
    """The codes of a name's tokens; ``before``, the last token at each place, goes on to this name's."""
    out = []
    for i, token in enumerate(_TOKEN.findall(name)):
        last = before.get(i)
        if token == last:
            out.append("=")
            continue
        a, b = _number(token), last and _number(last)
        out.append(f"+{a - b}" if a is not None and b is not None and a >= b else f".{token}")
        before[i] = token
    return out


def _name(codes: list[str], before: dict[int, str]) -> str:
    """The inverse of ``_codes``."""
    for i, code in enumerate(codes):
        if code[0] == ".":
            before[i] = code[1:]
        elif code[0] == "+":
            before[i] = str(int(before[i]) + int(code[1:]))
    return "".join(before[i] for i in range(len(codes)))


def _in_blocks(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """Rows of a block in one task, in order."""
    return rows.repartition(F.floor(F.col(key) / NAME_BLOCK)).sortWithinPartitions(key, *more)


def _named(names: DataFrame, key: str) -> DataFrame:
    return _in_blocks(names.select(F.col(key).cast("long").alias(key), "id").where("id is not null"), key)


def coded(names: DataFrame, key: str = "ordinal") -> DataFrame:
    """ordinal, place, code for names (ordinal, id): each token against that of the row before at its place: = for an equal one, + and the difference for numbers
    of which the latter isn't less, else . and the token. Blocks of ``NAME_BLOCK`` places stand alone, so that tasks code them apart; names are cut into tokens when their block is together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before = None, {}
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for k, name in zip(keys, batch.column(1).to_pylist(), strict=True):
                if k // NAME_BLOCK != block:
                    block, before = k // NAME_BLOCK, {}
                rows.append(_codes(name, before))
            sizes = np.array([len(r) for r in rows])
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(places.astype(np.int32)), pa.array(list(chain.from_iterable(rows)), pa.string())], names=[key, "place", "code"])

    return _named(names, key).mapInArrow(run, f"`{key}` long, place int, code string")


def decoded(codes: DataFrame, key: str = "ordinal") -> DataFrame:
    """The inverse of ``coded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, c) for batch in batches for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        block, before = None, {}
        keys, out = [], []
        for k, own in groupby(rows, key=lambda r: r[0]):
            if k // NAME_BLOCK != block:
                block, before = k // NAME_BLOCK, {}
            keys.append(k), out.append(_name([c for _, c in own], before))
            if len(keys) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=[key, "id"])
                keys, out = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=[key, "id"])

    return _in_blocks(codes.select(F.col(key).cast("long").alias(key), "place", "code"), key, "place").select(key, "code").mapInArrow(run, f"`{key}` long, id string")


#: Names of a stored piece of a block.
NAME_PIECE = 256
_CODEC = "zstd"


def packed(names: DataFrame, key: str = "ordinal") -> DataFrame:
    """The codes of ``coded`` as they are stored: a row for each ``NAME_PIECE`` names of a block, with what was at each place before them, so that it can be read alone; first, n, size and piece, the compressed
    keys, numbers of tokens and codes. Rows are a few KB each, whatever a reader makes of many of them at once."""

    def piece(keys: list[int], sizes: list[int], codes: list[str], before: list[str]) -> tuple[int, bytes]:
        codes = [*before, *codes]
        text = [c.encode() for c in codes]
        whole = b"".join([np.array([len(before), len(codes)], "<i8").tobytes(), np.array(keys, "<i8").tobytes(), np.array(sizes, "<i4").tobytes(), np.array([len(c) for c in text], "<i4").tobytes(), *text])
        return len(whole), pa.compress(whole, codec=_CODEC, asbytes=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, name) for batch in batches for k, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, own in groupby(rows, key=lambda r: r[0] // NAME_BLOCK):
            before, out = {}, []
            while part := list(islice(own, NAME_PIECE)):
                state = [before[i] for i in range(len(before))]
                codes = [_codes(name, before) for _, name in part]
                out.append((part[0][0], len(part), *piece([k for k, _ in part], [len(c) for c in codes], list(chain.from_iterable(codes)), state)))
                if len(out) == 64:
                    yield _pieces_of(out)
                    out = []
            if out:
                yield _pieces_of(out)

    return _named(names, key).mapInArrow(run, "first long, n int, size int, piece binary")


def _pieces_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["first", "n", "size", "piece"])


def unpacked(pieces: DataFrame, key: str = "ordinal") -> DataFrame:
    """The names of ``packed`` pieces, each in its task, without a shuffle. Names without a token have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[tuple[int, str]] = []
            for i in range(batch.num_rows):
                n, size, held = (c[i].as_py() for c in batch.columns)
                whole = pa.decompress(held, size, codec=_CODEC, asbytes=True)
                known, every = np.frombuffer(whole, "<i8", 2).tolist()
                keys, sizes, ends = np.frombuffer(whole, "<i8", n, 16).tolist(), np.frombuffer(whole, "<i4", n, 16 + 8 * n).tolist(), np.cumsum(np.frombuffer(whole, "<i4", every, 16 + 12 * n), dtype=np.int64).tolist()
                text = memoryview(whole)[16 + 12 * n + 4 * every :]
                codes = [str(text[u:v], "utf-8") for u, v in zip([0, *ends], ends, strict=False)]
                before, at, out = dict(enumerate(codes[:known])), known, []
                for m in sizes:
                    out.append(_name(codes[at : at + m], before))
                    at += m
                kept += [(k, x) for k, x, m in zip(keys, out, sizes, strict=True) if m]
                if len(kept) >= 10_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.string())], names=[key, "id"])
                    kept = []

    return pieces.select("n", "size", "piece").mapInArrow(run, f"`{key}` long, id string")


def _digit_place(name: Column) -> Column:
    """Place of the mate digit: after the first space before "1:", else before 1; 0 if there is none."""
    colon, plain = F.instr(name, " 1:"), F.instr(name, " 1")
    return F.when(colon > 0, colon + 1).when(plain > 0, plain + 1).otherwise(0)


def _with_digit(name: Column, place: Column, digit: str) -> Column:
    return F.concat(F.substring(name, F.lit(1), place - 1), F.lit(digit), F.substring(name, place + 1, F.length(name)))


def pair_code(a: Column, b: Column) -> Column:
    """How the second name follows from the first: 1 (a last 1 becomes 2), 2 (equal), 3 (the digit after a space), else 0."""
    place = _digit_place(a)
    last = (F.right(a, F.lit(1)) == "1") & (b == F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit("2")))
    return F.when(last, 1).when(a == b, 2).when((place > 0) & (b == _with_digit(a, place, "2")), 3).otherwise(0)


def mate_name(a: Column, code: Column) -> Column:
    """The second name, by the code; null for code 0."""
    return F.when(code == 1, F.concat(F.substring(a, F.lit(1), F.length(a) - 1), F.lit("2"))).when(code == 2, a).when(code == 3, _with_digit(a, _digit_place(a), "2"))


def index_suffix(i1: Column, i2: Column | None = None) -> Column:
    return i1 if i2 is None else F.concat(i1, F.lit("+"), i2)


def strip_index(name: Column, suffix: Column) -> Column:
    """The name without what follows its last colon, if that is the suffix."""
    return F.when(F.endswith(name, F.concat(F.lit(":"), suffix)), F.substring(name, F.lit(1), F.length(name) - F.length(suffix))).otherwise(name)


def restore_index(name: Column, suffix: Column) -> Column:
    return F.when(F.endswith(name, F.lit(":")), F.concat(name, suffix)).otherwise(name)


def has_barcode_tag(name: Column) -> Column:
    return F.contains(name, F.lit("CB:Z:"))


def has_umi_tag(name: Column) -> Column:
    return F.contains(name, F.lit("UB:Z:")) | F.contains(name, F.lit("UR:Z:")) | F.contains(name, F.lit("UMI:"))
