"""Approximate kNN over inverted lists (R-03).

``build_lists`` cuts the index into cells around k-means centres, fitted on a bounded sample, and
stores every row in the list of its nearest centre: one Parquet folder per cell, lists longer
than ``PART_ROWS`` in parts. Beside them lies one small row per cell: centre, radius (distance of
its farthest row), rows and parts.

``knn_lists`` probes the ``nprobe`` cells nearest to each query; only their folders are read.
With ``complete`` a second round follows for queries that need it: a cell can hold a better row
only if its centre is nearer than the k-th best distance plus the cell's radius. The answer is then
exact whatever the cells are like, and the probes are what is saved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators.retrieval import QUERY_BLOCK, SCORE_DIGITS, _matrix, group_scorer
from tidemark.session import scratch_path

#: Most cells (their centres go to every task), rows k-means is fitted on, rows of a part of a list.
MAX_CELLS, SAMPLE_ROWS, PART_ROWS = 4096, 100_000, 20_000


def _unit(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has a direction, with it as ``_unit``."""
    v = F.transform(F.col(vec).cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return (df.where(F.col(vec).isNotNull()).withColumn("_n", norm).where("_n > 0")
            .withColumn("_unit", F.transform(v, lambda x: x / F.col("_n"))).drop("_n"))


def build_lists(index: DataFrame, path: str, *, cells: int | None = None, key: str = "chunk_id",
                vec: str = "embedding", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> None:
    """Write the lists of ``index`` to ``path``. ``cells`` defaults to the root of the number of
    rows, ``MAX_CELLS`` at most. NULL and zero vectors match nothing and are left out; vectors
    must be of one width. K-means sees about ``sample_rows`` rows, chosen by a hash of the key."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = index.sparkSession
    at = scratch_path(spark, "unit-vectors")
    _unit(index, vec).write.parquet(at)
    rows = spark.read.parquet(at)
    n = rows.count()
    if not n:
        rows.drop("_unit").withColumn("_part", F.lit(0)).withColumn("_cell", F.lit(0)).coalesce(1).write.parquet(f"{path}/lists")
        spark.createDataFrame([], "cell int, centre array<double>, radius double, rows long, parts int").write.parquet(f"{path}/cells")
        return
    cells = max(2, min(cells or int(n ** 0.5), MAX_CELLS, n))
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n)) < sample_rows
    fitted = (KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_v", predictionCol="_cell")
              .fit(rows.where(share).select(array_to_vector("_unit").alias("_v"))))
    centres = np.array(fitted.clusterCenters())
    dealt = fitted.transform(rows.withColumn("_v", array_to_vector("_unit"))).drop("_v")
    lists = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "_cell int, centre array<double>")
    apart = F.sqrt(F.aggregate(F.zip_with("_unit", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    per = (dealt.join(F.broadcast(lists), "_cell").groupBy("_cell")
           .agg(F.max(apart).alias("radius"), F.count(F.lit(1)).alias("rows"))
           .join(lists, "_cell").select(F.col("_cell").alias("cell"), "centre", "radius", "rows",
                                        F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts")))
    per.write.parquet(f"{path}/cells")
    parts = spark.read.parquet(f"{path}/cells").select(F.col("cell").alias("_cell"), "parts")
    placed = (dealt.join(F.broadcast(parts), "_cell")
              .withColumn("_part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts", "_unit"))
    placed.repartition("_cell", "_part").sortWithinPartitions("_cell", "_part").write.partitionBy("_cell").parquet(f"{path}/lists")


def _probes(queries: DataFrame, cells: pd.DataFrame, nprobe: int, query_type: str, rest: bool) -> DataFrame:
    """``(_q, _qv, _cell)``: the ``nprobe`` nearest cells, or with ``rest`` the others that the
    query's k-th distance ``_far`` does not rule out."""
    centres, radius, number = np.stack(cells["centre"].to_list()), cells["radius"].to_numpy(), cells["cell"].to_numpy()
    spread = (centres * centres).sum(axis=1)

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                q = _matrix(part["_qv"])
                apart = np.sqrt(np.maximum(1 + spread - 2 * (q @ centres.T), 0))
                near = np.argsort(apart, axis=1, kind="stable")
                first = np.zeros(apart.shape, dtype=bool)
                np.put_along_axis(first, near[:, :nprobe], True, axis=1)
                if rest:
                    first = ~first & (apart - radius <= part["_far"].to_numpy()[:, None] + 1e-6)
                row, cell = np.nonzero(first & ~np.isnan(apart))
                if len(row):
                    yield pd.DataFrame({"_q": part["_q"].iloc[row].tolist(), "_qv": part["_qv"].iloc[row].tolist(), "_cell": number[cell]})
    return queries.mapInPandas(run, f"_q {query_type}, _qv array<double>, _cell int")


def only_cells(lists: DataFrame, probes: DataFrame) -> DataFrame:
    """The lists that are probed, by name (at most ``MAX_CELLS``), so that no other folder is read."""
    return lists.where(F.col("_cell").isin([r[0] for r in probes.select("_cell").distinct().collect()]))


def knn_lists(queries: DataFrame, path: str, k: int = 5, *, nprobe: int = 8, complete: bool = True, key: str = "chunk_id",
              query_key: str = "query_id", query_vec: str = "embedding", vec: str = "embedding") -> DataFrame:
    """R-03: ``query_id, rank, <key>, score`` from the lists at ``path``; ties by key, as in ``knn``.

    Without ``complete`` a query may miss rows outside its ``nprobe`` cells. Queries without a
    direction have no answer.
    """
    spark = queries.sparkSession
    cells = spark.read.parquet(f"{path}/cells").toPandas()       # at most MAX_CELLS rows
    lists = spark.read.parquet(f"{path}/lists")
    types = dict(lists.dtypes)
    query_type = dict(queries.dtypes)[query_key]
    result = f"{query_key} {query_type}, rank int, {key} {types[key]}, score double"
    if not len(cells):
        return spark.createDataFrame([], result)
    asked = _unit(queries.select(F.col(query_key).alias("_q"), F.col(query_vec).alias("_qv")), "_qv").select("_q", F.col("_unit").alias("_qv"))
    parts = spark.createDataFrame(cells[["cell", "parts"]].rename(columns={"cell": "_cell"}), "_cell int, parts int")

    def scored(probes: DataFrame) -> DataFrame:
        at = scratch_path(spark, "probes")
        probes.write.parquet(at)
        probes = spark.read.parquet(at)
        # A cell that many queries ask for meets them in blocks, as it meets them in parts.
        many = (probes.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("_blocks")).join(F.broadcast(parts), "_cell"))
        q = (probes.join(F.broadcast(many), "_cell").withColumn("_block", F.pmod(F.xxhash64("_q"), F.col("_blocks")))
             .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("_q", "_qv", "_cell", "_part", "_block"))
        rows = (only_cells(lists, probes).select(key, vec, "_cell", "_part").join(F.broadcast(many.select("_cell", "_blocks")), "_cell")
                .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks"))
        run = group_scorer(key, vec, [], k, None)
        group = ["_cell", "_part", "_block"]
        found = rows.groupBy(*group).cogroup(q.groupBy(*group)).applyInPandas(run, f"_q {query_type}, {key} {types[key]}, score double")
        kept = scratch_path(spark, "candidates")
        found.write.parquet(kept)
        return spark.read.parquet(kept)

    found = scored(_probes(asked, cells, nprobe, query_type, rest=False))
    by = Window.partitionBy("_q").orderBy(F.col("score").desc())
    if complete and nprobe < len(cells):
        kth = (found.withColumn("_n", F.row_number().over(by)).where(F.col("_n") == k)
               .select("_q", F.sqrt(F.greatest(2 - 2 * (F.col("score") - 10.0 ** -SCORE_DIGITS), F.lit(0.0))).alias("_far")))
        open_ = asked.join(kth, "_q", "left").withColumn("_far", F.coalesce("_far", F.lit(4.0)))
        found = found.unionByName(scored(_probes(open_, cells, nprobe, query_type, rest=True)))
    w = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col(key).asc())
    return (found.withColumn("score", F.round("score", SCORE_DIGITS)).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k).select(F.col("_q").alias(query_key), "rank", key, "score"))
