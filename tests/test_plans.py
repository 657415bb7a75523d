"""Plan shapes that matter at scale."""

from pyspark.sql import functions as F

from conftest import SF001
from tidemark.operators import catalog as cat
from tidemark.sources.fixtures import fixtures


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inventory_scan_never_reads_content(spark, tmp_path):
    from tidemark.sources.corpus import scan_inventory
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.mp4").write_bytes(b"12345")
    df = scan_inventory(spark, str(tmp_path), prefix="a")
    assert [(r.object_key, r.object_size) for r in df.collect()] == [("a/x.mp4", 5)]
    plan = _plan(df)
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_files_page_is_take_ordered(spark):
    _, catalog = fixtures(spark, SF001, "fx_listing", "fx_catalog")
    page, _ = cat.files_page(catalog, status="UPLOADED", limit=20)
    assert "TakeOrderedAndProject" in _plan(page)


def test_filters_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where(F.col("doc_id") > 10).select("doc_id")
    plan = _plan(docs)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,10)]" in plan
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_last_wins_is_a_partial_aggregate(spark):
    df = spark.createDataFrame([("s", "f", 1, "a"), ("s", "f", 2, "b")], "source_name string, file_id string, seq int, v string")
    out = cat.last_wins(df, ["source_name", "file_id"], ["seq"])
    assert out.collect()[0].v == "b"
    plan = _plan(out)
    assert "partial_max_by" in plan and "Window" not in plan


def test_config_joins_never_shuffle_on_the_source_alone(spark):
    from tidemark.operators.joins import with_config
    from tidemark.plans.audit import objects_under_prefixes

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([("a", f"f{i}") for i in range(50)] + [(None, "x"), ("b", "y")],
                                      "source_name string, file_id string")
        cfg = spark.createDataFrame([("a", "pre")], "source_name string, object_prefix string")
        out = with_config(files, cfg)
        plan = out._jdf.queryExecution().toString()
        assert "hashpartitioning(source_name" in plan and "_salt" in plan
        assert not any("hashpartitioning(source_name" in ln and "_salt" not in ln for ln in plan.splitlines())
        rows = out.collect()
        assert len(rows) == 52 and sum(r.object_prefix == "pre" for r in rows) == 50
        objs = spark.createDataFrame([(f"a/{i}", 1) for i in range(40)] + [("ab", 1), ("z", 1)],
                                     "object_key string, object_size int")
        pre = spark.createDataFrame([("a", "a"), ("t", "a/"), ("n", "")], "source_name string, prefix string")
        got = objects_under_prefixes(objs, pre).groupBy("source_name").count().collect()
        assert {r[0]: r[1] for r in got} == {"a": 41, "t": 40, "n": 42}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
