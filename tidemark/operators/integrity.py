"""Byte and frame integrity operators (C-06, A-04..A-07, J-07).

Hashes are computed in a projection over each side's own scan (the content column never
crosses a shuffle); only the small hash rows are joined.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions._util import col
from tidemark.functions.sizes import MIB, chunk_ranges
from tidemark.sources.files import open_input


def as_bytes(content: Column | str) -> Column:
    """Binary view of a content column (strings become their UTF-8 bytes)."""
    return col(content).cast("binary")


def range_read(content: Column | str, offset: Column | str, length: Column | str) -> Column:
    """C-06: bytes ``[offset, offset + length)`` of a content column (binary or string)."""
    return col(content).substr((col(offset) + 1).cast("int"), col(length).cast("int"))


def content_hash(content: Column | str) -> Column:
    """A-05: SHA-256 hex of a whole content column."""
    return F.sha2(as_bytes(content), 256)


def range_hashes(df: DataFrame, key: str, content: str, chunk: int = MIB, full: bool = False) -> DataFrame:
    """Per file: its size and the SHA-256 of the head/middle/tail ranges of its own size.

    Rows: ``key, size, name, offset, length, sha256`` (no row for an empty file); with
    ``full`` one more column ``full_sha256`` per row. Used on both copies: ranges only matter
    when the sizes agree, so each side may derive them from its own size.
    """
    size = F.length(col(content)).cast("bigint")
    base = df.select(col(key).alias(key), col(content).alias("_c"), size.alias("size"))
    extra = [content_hash("_c").alias("full_sha256")] if full else []
    exploded = base.select(key, "size", "_c", *extra, F.explode(chunk_ranges("size", chunk)).alias("_r"))
    return exploded.select(
        key, "size", F.col("_r.name").alias("name"), F.col("_r.offset").alias("offset"),
        F.col("_r.length").alias("length"),
        F.sha2(as_bytes(range_read("_c", "_r.offset", "_r.length")), 256).alias("sha256"),
        *(["full_sha256"] if full else []))


def hash_compare(source_hashes: DataFrame, store_hashes: DataFrame, key: str) -> DataFrame:
    """J-07: the two copies' range hashes side by side on ``(key, range name)``."""
    s = source_hashes.select(key, "name", "offset", "length", F.col("sha256").alias("source_sha256"))
    t = store_hashes.select(key, "name", F.col("sha256").alias("store_sha256"))
    j = s.join(t, [key, "name"], "left")
    return j.withColumn("match", F.coalesce(F.col("source_sha256") == F.col("store_sha256"), F.lit(False)))


def all_ranges_match(compared: DataFrame, key: str) -> DataFrame:
    """A-04: per file the number of ranges, any mismatch, and non-empty-and-all-match."""
    return compared.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_ranges"),
        F.sum(F.col("match").cast("int")).cast("bigint").alias("ranges_matched"),
        F.bool_or(~F.col("match")).alias("any_mismatch"),
        F.bool_and(F.col("match")).alias("all_match"))


def pixel_stddev(pixels: Column | str, scale: Column | str | float = 1.0) -> Column:
    """A-06: sample standard deviation of ``scale * pixel`` over an array, 0.0 under two
    pixels, NULL for a NULL array (an undecodable sample). One Welford pass over the array
    (numerically stable), no explode and no shuffle."""
    p = col(pixels)
    s = scale if isinstance(scale, Column) else (F.col(scale) if isinstance(scale, str) else F.lit(float(scale)))
    init = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(acc, x):
        v = x.cast("double") * s
        n = acc["n"] + 1
        delta = v - acc["mean"]
        mean = acc["mean"] + delta / n
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["m2"] + delta * (v - mean)).alias("m2"))

    m2 = F.aggregate(p, init, step, lambda acc: acc["m2"])
    n = F.size(p)
    return F.when(p.isNull(), F.lit(None).cast("double")).when(n < 2, F.lit(0.0)).otherwise(F.sqrt(m2 / (n - 1)))


def frame_verdict(samples: DataFrame, key: str) -> DataFrame:
    """A-07: per file, the first sample in offset order whose variance is below its threshold
    fails the file (its values are reported), else the last decodable sample's variance.

    ``samples``: ``key, rel, variance, min_variance``; NULL variance = undecodable, ignored.
    A grouped aggregate with partial aggregation: a file with many samples costs no more than
    one row per map partition in the shuffle.
    """
    ok = samples.where(F.col("variance").isNotNull())
    low = F.col("variance") < F.col("min_variance")
    return ok.groupBy(key).agg(
        F.min_by(F.when(low, F.struct("rel", "variance", "min_variance")),
                 F.when(low, F.col("rel"))).alias("failed"),
        F.max_by("variance", "rel").alias("last_variance"),
        F.count(F.lit(1)).alias("n_samples"))


def hash_files(paths: DataFrame, path_col: str = "path", block: int = MIB) -> DataFrame:
    """A-05 for files too large for one binary value: stream each file through SHA-256 inside
    the task (constant memory); Spark spreads the paths over tasks."""
    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf[path_col]:
                h = hashlib.sha256()
                try:
                    with open_input(p) as fh:
                        for piece in iter(lambda: fh.read(block), b""):
                            h.update(piece)
                    out.append(h.hexdigest())
                except FileNotFoundError:
                    out.append(None)
            yield pd.DataFrame({path_col: pdf[path_col], "sha256": out})
    return paths.select(path_col).mapInPandas(run, f"{path_col} string, sha256 string")


def read_ranges(requests: DataFrame, path_col: str = "path", keep: list[str] | None = None) -> DataFrame:
    """C-06 for large files: ``path, name, offset, length`` rows, each read by seeking inside
    the task, a block at a time; returns the rows (with the columns ``keep``) with the ``sha256``
    of the range. A file that cannot be opened, or ends inside the range, keeps its row with a
    NULL hash and the reason in ``read_error``."""
    def hashed(path: str, offset: int, length: int) -> tuple[str | None, str | None]:
        try:
            with open_input(path) as fh:
                fh.seek(offset)
                h, left = hashlib.sha256(), length
                while left > 0:
                    piece = fh.read(min(MIB, left))
                    if not piece:
                        return None, f"EOFError: {left} bytes short"
                    h.update(piece)
                    left -= len(piece)
                return h.hexdigest(), None
        except (OSError, ValueError) as exc:
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches):
        for pdf in batches:
            got = [hashed(p, int(o), int(n)) for p, o, n in zip(pdf[path_col], pdf["offset"], pdf["length"], strict=True)]
            yield pdf.assign(sha256=[g[0] for g in got], read_error=[g[1] for g in got])

    wanted = requests.select(*(keep or []), path_col, "name", "offset", "length")
    return wanted.mapInPandas(run, wanted.schema.simpleString()[7:-1] + ", sha256 string, read_error string")
