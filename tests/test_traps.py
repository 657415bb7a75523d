"""Traps where the reference's code, comments and tests disagree."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.sizes import sample_offsets
from tidemark.operators import catalog as cat
from tidemark.operators.retrieval import corpus_labels, knn_postfilter, upsert_index
from tidemark.plans.sync import discover, plan_sync

T0 = dt.datetime(2024, 1, 1)
CAT = ("id bigint, source_name string, file_id string, file_name string, checksum string, size bigint, "
       "status string, object_key string, attempt_count int, last_error string, created_at timestamp, "
       "updated_at timestamp")
LST = "source_name string, file_id string, file_name string, mime_type string, md5 string, size bigint"


def _cat(spark, rows):
    return spark.createDataFrame(rows, CAT)


def test_t1_changed_corrupted_file_is_requeued(spark):
    c = _cat(spark, [(1, "s", "f1", "a.mp4", "old", 10, "CORRUPTED", "s/f1_a.mp4", 0, "bad", T0, T0),
                     (2, "s", "f2", "b.mp4", "same", 10, "UPLOADED", "s/f2_b.mp4", 0, None, T0, T0)])
    l = spark.createDataFrame([("s", "f1", "a.mp4", "video/mp4", "new", 10), ("s", "f2", "b.mp4", "video/mp4", "same", 10)], LST)
    nxt, work = discover(l, c, as_of=T0 + dt.timedelta(hours=1))
    st = {r.file_id: r.status for r in nxt.collect()}
    assert st == {"f1": "NEW", "f2": "UPLOADED"} and work.count() == 2


def test_t2_status_changed_at_ages_processing_rows(spark):
    rows = [(1, "s", "f1", "a.mp4", "x", 10, "PROCESSING", "s/f1_a.mp4", 0, None, T0, T0 + dt.timedelta(hours=5))]
    c = _cat(spark, rows).withColumn("status_changed_at", F.lit(T0))
    out, obs = cat.reset_stale(c, as_of=T0 + dt.timedelta(hours=5), older_than=3600, age_col="status_changed_at")
    r = out.collect()[0]
    assert r.status == "FAILED" and r.last_error == "stale_processing_reset" and r.attempt_count == 0
    assert obs.get["reset"] == 1
    out2, _ = cat.reset_stale(c, as_of=T0 + dt.timedelta(hours=5), older_than=3600)   # updated_at: fresh
    assert out2.collect()[0].status == "PROCESSING"


def test_t3_four_sample_points(spark):
    df = spark.createDataFrame([(100 * (1 << 20),)], "s bigint")
    pts = df.select(F.explode(sample_offsets("s")).alias("p")).select("p.*").collect()
    assert [p.rel for p in pts] == [0.0, 0.33, 0.66, 0.97]
    assert [p.offset for p in pts] == [0, 33 << 20, 66 << 20, 97 << 20] and pts[3].min_variance == 2.0


def test_t6_t11_corrupted_with_object_is_inconsistent_and_key_rule(spark):
    from tidemark.plans.audit import audit_sources
    c = _cat(spark, [(1, "s", "f1", "a.mp4", "x", 10, "CORRUPTED", "s/f1_a.mp4", 0, None, T0, T0)])
    l = spark.createDataFrame([("s", "f1", "a.mp4", "video/mp4", "x", 10)], LST)
    inv = spark.createDataFrame([("s/f1_a.mp4", 10)], "object_key string, object_size bigint")
    rep = audit_sources(l, c, inv)
    assert [r.issues for r in rep.items.collect()] == [["db_inconsistent"]]


def test_t7_repo_label_matches_whole_path_parts(spark):
    files = spark.createDataFrame([("/git/infra-rg/a.py",), ("/git/infra/b.py",), ("/other/c.py",)], "path string")
    roots = spark.createDataFrame([("/git/infra",), ("/git/infra-rg",)], "root string")
    got = {r.path: (r.repo, r.rel_path) for r in corpus_labels(files, roots).collect()}
    assert got["/git/infra-rg/a.py"] == ("infra-rg", "infra-rg/a.py")
    assert got["/git/infra/b.py"] == ("infra", "infra/b.py")
    assert got["/other/c.py"][0] == "unknown"


def test_t8_prune_removes_stale_chunks(spark):
    old = spark.createDataFrame([("/r/a.py::0::1", "/r/a.py"), ("/r/gone.py::0::1", "/r/gone.py")], "chunk_id string, file string")
    new = spark.createDataFrame([("/r/a.py::0::2", "/r/a.py")], "chunk_id string, file string")
    assert upsert_index(old, new).count() == 3                       # literal: old chunks stay
    corpus = spark.createDataFrame([("/r/a.py",)], "file string")
    assert [r.chunk_id for r in upsert_index(old, new, prune=True, corpus_keys=corpus).collect()] == ["/r/a.py::0::2"]


def test_t9_postfilter_may_return_fewer_than_k(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    idx = spark.createDataFrame([(i, [1.0, i / 10.0], f"f{i}.py" if i == 9 else f"f{i}.md") for i in range(10)],
                                "chunk_id bigint, embedding array<float>, rel_path string")
    out = knn_postfilter(q, idx, 2, ext="py").collect()
    assert out == []                                                  # the .py file ranks 10th > 3k = 6


def test_t10_name_search_does_not_escape_wildcards(spark):
    c = _cat(spark, [(1, "s", "f1", "a_b.mp4", "x", 1, "NEW", None, 0, None, T0, T0),
                     (2, "s", "f2", "axb.mp4", "x", 1, "NEW", None, 0, None, T0, T0)])
    assert cat.filter_files(c, name_contains="A_B").count() == 2


def test_t14_size_checked_before_checksum(spark):
    c = _cat(spark, [(1, "s", "f1", "a.mp4", "abc", 10, "NEW", None, 0, None, T0, T0)])
    l = spark.createDataFrame([("s", "f1", "a.mp4", "video/mp4", "abc", 10)], LST)
    inv = spark.createDataFrame([("s/f1_a.mp4", 9, {"checksum": "ABC"})], "object_key string, object_size bigint, metadata map<string,string>")
    r = plan_sync(l, c, inv, as_of=T0).collect()[0]
    assert (r.action, r.reason) == ("TRANSFER", "size")


def test_t15_stale_reset_keeps_attempts(spark):
    c = _cat(spark, [(1, "s", "f1", "a.mp4", "x", 10, "PROCESSING", None, 3, None, T0, T0)])
    out, _ = cat.reset_stale(c, as_of=T0 + dt.timedelta(days=1))
    assert out.collect()[0].attempt_count == 3


def test_assign_ids_are_contiguous_in_key_order(spark):
    rows = spark.createDataFrame([("s", f"f{i:03d}") for i in range(50)][::-1], "source_name string, file_id string")
    got = cat.assign_ids(rows, 100).orderBy("id").collect()
    assert [r.id for r in got] == list(range(101, 151))
    assert [r.file_id for r in got] == sorted(r.file_id for r in got)
