"""Copy, approximate kNN recall, staleness timers and stream replays."""

import datetime as dt
import json
import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF001, SF01


def test_copy_objects_streams_bytes_and_metadata(spark, tmp_path):
    from tidemark.operators.transfer import copy_objects, local_put
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.bin").write_bytes(os.urandom(3000))
    plan = spark.createDataFrame(
        [("s", "f1", "s/f1_a.mp4", "abc", str(src / "a.bin")), ("s", "f2", "s/f2_b.mp4", None, str(src / "missing"))],
        "source_name string, file_id string, object_key string, checksum string, src_path string")
    out = {r.file_id: r for r in copy_objects(plan, local_put(str(tmp_path / "dst"), part_bytes=1024)).collect()}
    assert out["f1"].ok and out["f1"].bytes_written == 3000 and not out["f2"].ok
    assert (tmp_path / "dst" / "s" / "f1_a.mp4").read_bytes() == (src / "a.bin").read_bytes()
    meta = json.loads((tmp_path / "dst" / "s" / "f1_a.mp4.meta.json").read_text())
    assert meta == {"checksum": "abc", "drive_file_id": "f1"}


def test_knn_approx_recall(spark):
    q = entry.queries()
    exact = {(r.query_id, r.chunk_id) for r in q["knn"](spark, SF01).collect()}
    approx = {(r.query_id, r.chunk_id) for r in q["knn_approx"](spark, SF01).collect()}
    assert len(exact & approx) / len(exact) >= 0.6
    want, got = ({i: sum(x == i for x, _ in s) for i, _ in exact} for s in (exact, approx))
    assert got == want                                          # k rows for every query


def test_knn_ids_of_any_type_and_unusable_vectors(spark):
    from tidemark.operators.retrieval import knn, knn_approx
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)],
                                  "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([("q1", [2.0, 0.1]), ("q0", [0.0, 0.0]), ("qn", None)], "query_id string, embedding array<float>")
    for fn in (knn, knn_approx):
        got = [(r.query_id, r["rank"], r.chunk_id) for r in fn(queries, index, 2).orderBy("query_id", "rank").collect()]
        assert got == [("q1", 1, "a"), ("q1", 2, "b")], fn


def test_failed_embedding_batches_are_not_stored(spark):
    from tidemark.operators.retrieval import embed_with
    from tidemark.plans.index import index_texts

    def fn(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([("/r/a", "1", "good"), ("/r/b", "1", "bad")], "path string, mtime string, text string")
    roots = spark.createDataFrame([("/r",)], "root string")
    out = index_texts(texts, roots, embed=lambda df: embed_with(df, fn, batch=1))
    assert [r.file for r in out.collect()] == ["/r/a"] and "embed_error" not in out.columns


def test_new_stream_checkpoint_writes_new_versions(spark, tmp_path):
    """Versions outlive a checkpoint: a fresh one starts at batch 0 again and must not be skipped."""
    from tidemark.streaming.jobs import LISTING_SCHEMA, stream_discover
    from tidemark.streaming.snapshots import read_version, versions, write_version
    from tidemark.queries import _sync_inputs
    _, catalog, _ = _sync_inputs(spark, SF001)
    table = str(tmp_path / "catalog")
    write_version(catalog, table, 0)
    at = dt.datetime(2030, 1, 1)
    for run in range(2):
        rows = [("s", f"new{run}", "x.mp4", "video/mp4", f"{k}", 5, at + dt.timedelta(seconds=k)) for k in (2, 1)]
        spark.createDataFrame(rows, LISTING_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{run}"))
        for _ in range(2):                                      # the second start finds nothing to do
            stream_discover(spark, str(tmp_path / f"in{run}"), table, str(tmp_path / f"ckpt{run}")).awaitTermination()
    assert versions(spark, table) == [0, 1, 2]
    new = read_version(spark, table).where("source_name = 's'").orderBy("id").collect()
    assert [(r.file_id, r.checksum) for r in new] == [("new0", "2"), ("new1", "2")]   # one row, the last listed
    assert new[1].id == new[0].id + 1


def test_stream_stale_emits_unfinished_processing(spark, tmp_path):
    from tidemark.streaming.jobs import stream_stale
    t0 = dt.datetime(2024, 1, 1)
    schema = "source_name string, file_id string, status string, ts timestamp"
    batches = [
        [("s", "a", "PROCESSING", t0), ("s", "b", "PROCESSING", t0), ("s", "b", "UPLOADED", t0 + dt.timedelta(minutes=5))],
        [("s", "z", "NEW", t0 + dt.timedelta(hours=3))],
        [("s", "y", "NEW", t0 + dt.timedelta(hours=4))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .parquet(str(tmp_path / "in")))
    q = (stream_stale(src, limit_seconds=3600).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = [(r.file_id, r.stale) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("a", True)]


def test_stream_discover_replay_changes_nothing(spark):
    """Running the discovery stream again over the same snapshots yields the same catalog."""
    q = entry.queries()["stream_discover"]
    first = sorted(tuple(r) for r in q(spark, SF001).drop("created_at").collect())
    second = sorted(tuple(r) for r in q(spark, SF001).drop("created_at").collect())
    assert first == second
