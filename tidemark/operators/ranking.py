"""Ranks without a global single-partition window (used by S-07 and W-04).

Rows are range-partitioned by the order and written once to the shared scratch folder with the
number of their partition. Counts and rows are then both read from that table, so they agree on
what a partition is, whatever sampling chose its bounds. ``global_rank`` adds running offsets of
the partitions to a rank inside each; ``group_rank`` does the same per group, and because the
ranges are on (group, order) a hot group is spread over many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranged(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return stored(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()), "ranked")


def _names(order: list[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def global_rank(df: DataFrame, order: list[Column | str], rank_col: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """1-based contiguous rank over the whole frame; ``order`` must be a total order."""
    o = _names(order)
    r = _ranged(df, o, num_partitions)
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row per partition: a single-partition window here is bounded by their number.
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    r = r.join(F.broadcast(offsets), "_pid")
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*o))
    return r.withColumn(rank_col, F.col("_off") + local).drop("_pid", "_off")


def group_rank(df: DataFrame, group: list[str], order: list[Column | str], rank_col: str = "rank",
               num_partitions: int | None = None, count_col: str | None = None) -> DataFrame:
    """1-based rank within each group, and with ``count_col`` the group's size; ``order`` must be
    a total order inside a group and group columns must not be null."""
    o = _names(order)
    r = _ranged(df, [*[F.col(g) for g in group], *o], num_partitions)
    counts = r.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"))
    # A group spans at most as many rows here as there are partitions.
    w = Window.partitionBy(*group)
    offsets = counts.select(
        "_pid", *group,
        F.coalesce(F.sum("_n").over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        *([F.sum("_n").over(w).alias(count_col)] if count_col else []))
    r = r.join(offsets, ["_pid", *group])
    local = F.row_number().over(Window.partitionBy("_pid", *group).orderBy(*o))
    return r.withColumn(rank_col, F.col("_off") + local).drop("_pid", "_off")


def group_running(df: DataFrame, group: list[str], order: list[Column | str], amounts: dict[str, Column],
                  num_partitions: int | None = None) -> DataFrame:
    """Running sums of ``amounts`` (new column -> integer amount) up to and with each row of its
    group, over partition borders; ``order`` must be a total order inside a group. Null group
    values are one group."""
    o = _names(order)
    df = df.select("*", *[v.alias(k) for k, v in amounts.items()])
    r = _ranged(df, [*[F.col(g) for g in group], *o], num_partitions)
    sums = r.groupBy("_pid", *group).agg(*[F.sum(k).alias(k) for k in amounts])
    # A group spans at most as many rows here as there are partitions.
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_pid").alias("_op"), *[F.col(g).alias(f"_o_{g}") for g in group],
                          *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_off_{k}") for k in amounts])
    same = F.col("_pid") == F.col("_op")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    local = Window.partitionBy("_pid", *group).orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = [c for c in df.columns if c not in amounts]
    return r.join(offsets, same).select(
        *rest, *[(F.col(f"_off_{k}") + F.sum(k).over(local)).alias(k) for k in amounts])
