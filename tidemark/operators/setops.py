"""Set operations (U-02, U-03; U-01 and U-04 live with the audit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.sizes import MIB


def range_distinct(sizes: DataFrame, key: str, chunk: int = MIB) -> DataFrame:
    """U-02 in table form: head/middle/tail ranges per file, duplicates of ``(offset, length)``
    removed keeping the first name (a per-file aggregate, never a whole-table sort)."""
    s = F.col("size")
    ln = F.least(s, F.lit(chunk).cast("bigint"))
    raw = sizes.where(s > 0).select(key, F.posexplode(F.array(
        F.struct(F.lit("head").alias("name"), F.lit(0).cast("bigint").alias("offset"), ln.alias("length")),
        F.struct(F.lit("middle").alias("name"), F.greatest(F.lit(0).cast("bigint"), F.shiftright(s - ln, 1)).alias("offset"),
                 ln.alias("length")),
        F.struct(F.lit("tail").alias("name"), F.greatest(F.lit(0).cast("bigint"), s - ln).alias("offset"),
                 ln.alias("length")))).alias("pos", "r"))
    return (raw.groupBy(key, F.col("r.offset").alias("offset"), F.col("r.length").alias("length"))
            .agg(F.min_by("r.name", "pos").alias("name"))
            .select(key, "name", "offset", "length"))


def config_diff(a: DataFrame, b: DataFrame, key: str = "source_name", value: str = "folder_id") -> DataFrame:
    """U-03: name-to-folder mappings that differ between two configs, tagged by side."""
    x, y = a.select(key, value), b.select(key, value)
    return (x.exceptAll(y).withColumn("side", F.lit("only_in_a"))
            .unionByName(y.exceptAll(x).withColumn("side", F.lit("only_in_b"))))
