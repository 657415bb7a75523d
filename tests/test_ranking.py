"""Ranks and ids over more rows than a range partitioner samples, for several partition counts."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.catalog import CATALOG_COLUMNS, resolve_by_name, upsert_discovered
from tidemark.operators.ranking import global_rank


@pytest.fixture
def partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def wide(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("s"), (i % 3).cast("string")).alias("source_name"), F.sha1(i.cast("string")).alias("file_id"),
        F.concat(F.lit("n"), F.when(i % 3 == 0, F.lit(0)).otherwise(i % 500).cast("string")).alias("file_name"),
        F.lit("video/mp4").alias("mime_type"), F.repeat(F.sha1(i.cast("string")), 4).alias("md5"), i.alias("size"))


@pytest.mark.parametrize("n", [4, 8, 200])
def test_ids_are_unique_and_contiguous(spark, partitions, n):
    partitions(n)
    rows = 40_000 if n < 200 else 12_000
    empty = spark.createDataFrame([], "id bigint, source_name string, file_id string, file_name string, checksum string, size bigint, "
                                      "status string, object_key string, attempt_count int, last_error string, created_at timestamp, "
                                      "updated_at timestamp").select(*CATALOG_COLUMNS)
    seen = []
    for _ in range(2):
        out = upsert_discovered(empty, wide(spark, rows).union(wide(spark, 50)), as_of=F.lit("2030-01-01").cast("timestamp"))
        seen.append(out.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id"),
                            F.sum(F.pmod(F.xxhash64("file_id", "id"), F.lit(1 << 40)))).first())
    assert tuple(seen[0])[:4] == (rows, rows, 1, rows) and seen[0] == seen[1]


@pytest.mark.parametrize("n", [4, 8, 200])
def test_ranks_and_candidates_agree(spark, partitions, n):
    partitions(n)
    df = wide(spark, 30_000)
    r = global_rank(df, ["file_id"]).agg(F.countDistinct("rank"), F.max("rank")).first()
    assert tuple(r) == (30_000, 30_000)
    catalog = df.select("source_name", "file_name", "file_id", F.col("size").alias("id"), "size", F.lit("NEW").alias("status"),
                        F.lit("k").alias("object_key"), F.lit("2030-01-01").cast("timestamp").alias("updated_at"))
    requests = catalog.select("source_name", "file_name").distinct().union(spark.createDataFrame([("s0", "none")], "a string, b string"))
    runs = [resolve_by_name(requests, catalog).groupBy("outcome").agg(
        F.count("*").alias("n"), F.max("n_matches").alias("most"), F.max("candidate_rank").alias("rank"),
        F.sum(F.pmod(F.xxhash64("file_id", "candidate_rank"), F.lit(1 << 40))).alias("mark")).orderBy("outcome").collect() for _ in range(2)]
    assert runs[0] == runs[1]
    by = {x.outcome: x for x in runs[0]}
    assert sum(x.n for x in runs[0]) == 30_001 and by["not_found"].n == 1
    assert by["ambiguous"].most == by["ambiguous"]["rank"] == 10_000          # a third of all rows share one name
