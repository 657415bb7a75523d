"""Size, byte-range and sample-offset expressions (P-09, P-11, P-12)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions._util import col

MIB = 1 << 20

# Frame sample points as (fraction of the size, threshold override or None).
SAMPLE_POINTS = ((0.00, None), (0.33, None), (0.66, None), (0.97, 2.0))

RANGE_TYPE = "array<struct<name:string,offset:bigint,length:bigint>>"


def effective_size(listing_size: Column | str, row_size: Column | str | None = None) -> Column:
    """P-09: listing size when it is a non-empty number (the string "0" stays 0), else the
    catalog size, else 0."""
    s = F.nullif(strip_text(col(listing_size).cast("string")), F.lit("")).try_cast("bigint")
    parts = [s] + ([col(row_size).cast("bigint")] if row_size is not None else []) + [F.lit(0).cast("bigint")]
    return F.coalesce(*parts)


def strip_text(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def chunk_ranges(size: Column | str, chunk: int | Column = MIB) -> Column:
    """P-11: head, middle and tail ranges of ``min(size, chunk)`` bytes, duplicates of an
    earlier ``(offset, length)`` removed, none when ``size <= 0``."""
    s = col(size).cast("bigint")
    ln = F.least(s, (chunk if isinstance(chunk, Column) else F.lit(chunk)).cast("bigint"))

    def rng(name: str, offset: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), offset.cast("bigint").alias("offset"), ln.alias("length"))

    ranges = F.array(
        rng("head", F.lit(0)),
        rng("middle", F.greatest(F.lit(0).cast("bigint"), F.shiftright(s - ln, 1))),
        rng("tail", F.greatest(F.lit(0).cast("bigint"), s - ln)),
    )
    unique = F.filter(
        ranges,
        lambda x, i: ~F.exists(F.slice(ranges, F.lit(1), i),
                               lambda y: (y["offset"] == x["offset"]) & (y["length"] == x["length"])),
    )
    return F.when(s > 0, unique).otherwise(F.filter(ranges, lambda x: F.lit(False)))


def sample_offsets(size: Column | str, min_variance: float = 8.0) -> Column:
    """P-12: ``array<struct<rel, offset, min_variance>>`` - each point's byte offset floored
    to a whole MiB, with its variance threshold."""
    s = col(size).cast("double")
    points = []
    for rel, override in SAMPLE_POINTS:
        raw = F.floor(s * F.lit(rel))
        aligned = F.shiftleft(F.shiftright(raw, 20), 20)
        points.append(F.struct(F.lit(rel).alias("rel"), aligned.alias("offset"),
                               F.lit(override if override is not None else min_variance).cast("double")
                               .alias("min_variance")))
    return F.array(*points)
