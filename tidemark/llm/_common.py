"""Helpers shared by the corpus operators: written intermediates, hashed words, sorted groups.

Intermediates that are read more than once are written as Parquet below the shared folder of
``spark.checkpoint.dir``; that cuts lineage, so a lost executor costs a re-read and not a
recomputation of every step before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_path

U64 = np.uint64
#: Text is hashed in pieces of about this many bytes, so temporary arrays stay small.
SEGMENT_BYTES = 1 << 21

#: ASCII white space as the contracts define it: \\x20 and \\x09-\\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64 (wraps)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n + 1:
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n + 1, base, dtype=U64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE,
                lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once: (row, start byte, end byte, 64-bit hash) arrays.

    ``data`` holds the texts back to back and ``offsets`` their bounds; a word never spans two
    texts. ``lower`` maps A-Z to a-z in the hash only.
    """
    codes = _BYTE_LOWER if lower else _BYTE
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    parts = []
    at = 0
    while at < len(data):
        to = min(at + SEGMENT_BYTES, len(data))
        while to < len(data) and not (edge[to] or separator[data[to]]):
            to += 1
        piece = data[at:to]
        inside = ~separator[piece]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[at:to]))
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[at + 1:to + 1])) + 1
        up, down = _powers(len(piece))
        sums = np.zeros(len(piece) + 1, dtype=U64)
        np.cumsum(codes[piece] * up, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        parts.append((starts + at, ends + at, mix(h + (ends - starts).astype(U64) * _BASE)))
        at = to
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, U64)
    starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, starts, ends, hashes


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words (runs across texts included; mask them)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    out = np.zeros(count, dtype=U64)
    for k in range(n):
        out = out * _BASE + hashes[k:k + count]
    return mix(out)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
                limit: int = SEGMENT_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        piece = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal ``keys`` from batches sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        at = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[at]:
                continue
            if held and rows[at] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = rows[at]
            held.append(batch.slice(at, i - at))
            at = i
    if held:
        yield pa.Table.from_batches(held)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def rows_left(df: DataFrame) -> bool:
    return bool(df.limit(1).count())
