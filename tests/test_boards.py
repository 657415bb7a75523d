"""Boards, runs, offset pages, listing chains and the partitioned catalog on rows of our own."""

import glob
import json
import os
import random
import statistics

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boards, catalog as cat
from tidemark.session import scratch_path
from tidemark.sources.listing import listing_chain, read_pages, scan_listing_pages


def test_runs_over_partition_borders_and_null_differences(spark):
    hits = {k: random.Random(k).random() < 0.9 for k in range(4000)}
    rows = [("hot", k, 20.0 if hits[k] else (None if k % 2 else 16.0)) for k in range(4000)] + [("b", 1, 17.0), ("b", 9, 17.0), ("c", 1, 17.0)]
    df = spark.createDataFrame(rows, "cell string, frame long, difference double").repartition(5)
    got = sorted(tuple(r) for r in boards.stable_change(df, ["cell"], "frame").collect())
    want, run = [("b", 1, 9, 2)], []
    for k in range(4001):
        if k < 4000 and hits[k]:
            run.append(k)
        else:
            if len(run) >= 2:
                want.append(("hot", run[0], run[-1], len(run)))
            run = []
    assert got == sorted(want)


def test_median_of_a_group_with_half_the_rows(spark):
    r = random.Random(3)
    rows = [("hot" if k % 2 else f"g{k % 30}", r.choice([r.gauss(0, 1), r.gauss(240, 1e-3), 7.0, -1e12, 1e300])) for k in range(6000)]
    rows += [("one", 5.0), ("none", None), ("none", float("nan")), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: (x["n_values"], x["median"]) for x in boards.grouped_median(df, ["g"], "v").collect()}
    want = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    assert got == {g: (len(v), pytest.approx(statistics.median(v))) for g, v in want.items()}


def test_offsets_at_the_least_distance(spark):
    df = spark.createDataFrame([(1, 235.0, 234.0), (2, 240.0, None)], "b int, x double, y double")
    got = {x["b"]: (x["offset_x"], x["offset_y"], x["dx"], x["dy"]) for x in boards.grid_offset(df, ["b"]).collect()}
    assert got == {1: (5.0, 6.0, 0.0, 6.0), 2: (0.0, None, 0.0, 0.0)}


def test_merge_with_null_scores_and_ties(spark):
    kind = "c int, value string, confidence double"
    a = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.49), (3, "a", None), (4, "a", None), (5, "b", 0.7), (5, "a", 0.7), (6, None, 0.9), (None, "a", 0.9)], kind)
    b = spark.createDataFrame([(1, "f", 0.9), (2, "f", None), (4, "f", 0.1), (6, "f", 0.2), (7, "f", 0.1), (7, "g", 0.3), (None, "f", 0.1)], kind)
    got = {r["c"]: (r["value"], r["confidence"], r["predictor"]) for r in boards.merge_predictions(a, b, ["c"]).collect()}
    assert got == {1: ("a", 0.5, "primary"), 2: ("f", None, "fallback"), 3: ("a", None, "primary"), 4: ("f", 0.1, "fallback"),
                   5: ("a", 0.7, "primary"), 6: ("f", 0.2, "fallback"), 7: ("g", 0.3, "fallback"), None: ("a", 0.9, "primary")}


def test_setting_keys_and_places_with_ties(spark):
    rows = [({"b": "2", "a": "1"}, 1, 10, 7), ({"a": "1", "b": "2"}, 1, 5, 3), ({"a": "1;b=2"}, 1, 15, 1),
            ({"a": None}, 1, 1, 2), ({"a": None}, None, 99, 9)]
    df = spark.createDataFrame(rows, "params map<string,string>, board int, moves long, run long")
    got = {(r["scope"], r["board"], r["setting"]): (r["n_runs"], r["score"], r["best_run"], r["place"], r["dense_place"])
           for r in boards.sweep_leaderboard(df).collect()}
    assert got == {
        ("total", None, "a=1;b=2"): (2, 15, 7, 2, 2), ("total", None, "a=1\\;b\\=2"): (1, 15, 1, 2, 2), ("total", None, "a"): (2, 100, 9, 1, 1),
        ("board", 1, "a=1;b=2"): (2, 15, 7, 1, 1), ("board", 1, "a=1\\;b\\=2"): (1, 15, 1, 1, 1), ("board", 1, "a"): (1, 1, 2, 3, 2),
        ("board", None, "a"): (1, 99, 9, 1, 1)}


def test_first_frame_decides_for_the_clip(spark):
    up, low = list("PPp....." + "k" * 56), list("Ppp....." + "K" * 56)
    rows = [("a", 1, up), ("a", 2, low), ("b", 1, low), ("b", 2, up), (None, 3, up), ("n", 1, None), ("n", 2, up)]
    df = spark.createDataFrame(rows, "clip string, frame int, cells array<string>")
    got = {(r["clip"], r["frame"]): (r["cells"], r["reversed"]) for r in boards.orient_board(df, "clip", "frame").collect()}
    assert got == {(c, f): (x[::-1] if c == "a" else x, c == "a") for c, f, x in rows}


def test_offset_page_reads_once(spark):
    at = scratch_path(spark, "offset")
    spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "NEW").otherwise("FAILED").alias("status")).write.parquet(at)
    df = spark.read.parquet(at)
    page, seen = boards.offset_page(df, [F.col("id").desc()], 3, 100, status="NEW")
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert [r["id"] for r in page.collect()] == list(range(398, 198, -2)) and seen.get["total"] == 500
    last = boards.page_with_total(df, [F.col("id")], 4, 100, status="NEW").collect()
    assert len(last) == 100 and {(r["total"], r["has_next"]) for r in last} == {(500, False)}
    assert boards.page_with_total(df, [F.col("id")], 9, 100, status="NEW").count() == 0
    with pytest.raises(ValueError):
        boards.offset_page(df, [F.col("id")], 0, 201)


def _write(root, source, pages, rng):
    lines = [json.dumps({"pageToken": t, "files": [{"id": f"{source}{t}", "name": "a.mp4", "mimeType": "video/mp4", "size": "1"}],
                         "nextPageToken": n}) for t, n in pages]
    rng.shuffle(lines)
    os.makedirs(f"{root}/source_name={source}")
    for k in range(3):
        with open(f"{root}/source_name={source}/{k}.json", "w") as out:
            out.write("".join(x + "\n" for x in lines[k::3]))


def test_listing_chain_with_cycles_and_missing_pages(spark, tmp_path):
    rng, root = random.Random(1), str(tmp_path / "pages")
    long = [(None, "p1"), *[(f"p{k}", f"p{k + 1}") for k in range(1, 100)], ("p100", None)]
    _write(root, "long", long + long[5:9] + [("x", "p50"), ("y", "z")], rng)
    _write(root, "cycle", [(None, "a"), ("a", "b"), ("b", "c"), ("c", "a")], rng)
    _write(root, "gap", [("", "a"), ("a", "lost"), ("b", "")], rng)
    _write(root, "self", [(None, "a"), ("a", "a")], rng)
    _write(root, "headless", [("a", "b"), ("b", None)], rng)
    chain = {(r["source_name"], r["token"]): (r["position"], r["issue"]) for r in listing_chain(read_pages(spark, root)).collect()}
    want = {("long", "" if k == 0 else f"p{k}"): (k, None) for k in range(101)}
    want |= {("long", "x"): (None, "unreached"), ("long", "y"): (None, "unreached")}
    want |= {("cycle", t): (k, "cycle" if t == "c" else None) for k, t in enumerate(["", "a", "b", "c"])}
    want |= {("gap", ""): (0, None), ("gap", "a"): (1, "dangling"), ("gap", "b"): (None, "unreached")}
    want |= {("self", ""): (0, None), ("self", "a"): (1, "cycle"), ("headless", "a"): (None, "unreached"), ("headless", "b"): (None, "unreached")}
    assert chain == want
    files = [(r["source_name"], r["file_id"]) for r in scan_listing_pages(spark, root).collect()]
    assert len(files) == len(set(files)) == 101 + 4 + 2 + 2
    empty = read_pages(spark, root).where(F.lit(False))
    assert listing_chain(empty).count() == 0


def _catalog(spark, n):
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source_name"),
        F.concat(F.lit("f"), F.col("id")).alias("file_id"), F.lit("a.mp4").alias("file_name"), F.lit("c").alias("checksum"),
        F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, "NEW").otherwise("UPLOADED").alias("status"),
        F.sha2(F.col("id").cast("string"), 256).alias("object_key"), F.lit(0).alias("attempt_count"), F.lit(None).cast("string").alias("last_error"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))


def test_catalog_layout_prunes_folders_and_row_groups(spark):
    at = scratch_path(spark, "layout")
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        cat.write_snapshot(_catalog(spark, 30000).coalesce(1), at)
    finally:
        spark.conf.unset("parquet.block.size")
    one = cat.scan_catalog(spark, at, "hot", "UPLOADED")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_name" in plan and "EqualTo(status,UPLOADED)" in plan
    assert one.count() == 5000 and {os.path.basename(os.path.dirname(f)) for f in one.inputFiles()} <= {f"source_name={s}" for s in ["hot", *[f"s{k}" for k in range(7)]]}
    mixed = groups = 0
    for f in glob.glob(at.removeprefix("file:") + "/source_name=hot/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        column = meta.schema.names.index("status")
        for k in range(meta.num_row_groups):
            stat = meta.row_group(k).column(column).statistics
            groups, mixed = groups + 1, mixed + (stat.min != stat.max)
    assert groups > 0 and mixed <= len(glob.glob(at.removeprefix("file:") + "/source_name=hot/*.parquet"))


def test_upsert_replaces_only_the_named_sources(spark):
    at = scratch_path(spark, "layout")
    old = _catalog(spark, 700)
    cat.write_snapshot(old, at)
    root = at.removeprefix("file:")
    before = {s: sorted(os.listdir(f"{root}/{s}")) for s in os.listdir(root) if s.startswith("source_name=")}
    listing = spark.createDataFrame([("s1", "f1", "b.mp4", "n", 5), ("s1", "new", "b.mp4", "n", 5), ("fresh", "x", "b.mp4", "n", 5)],
                                    "source_name string, file_id string, file_name string, md5 string, size long")
    when = F.lit("2024-02-01").cast("timestamp_ntz")
    cat.upsert_partitions(at, listing, as_of=when)
    after = {s: sorted(os.listdir(f"{root}/{s}")) for s in os.listdir(root) if s.startswith("source_name=")}
    changed = {s for s in after if after[s] != before.get(s)}
    assert changed == {"source_name=s1", "source_name=fresh"}
    want = sorted(map(str, cat.upsert_discovered(old, listing, as_of=when).select(*cat.CATALOG_COLUMNS).collect()))
    assert sorted(map(str, cat.scan_catalog(spark, at).select(*cat.CATALOG_COLUMNS).collect())) == want
    # A run that broke off is repeated: the same rows come out.
    cat.upsert_partitions(at, listing, as_of=when)
    assert sorted(map(str, cat.scan_catalog(spark, at).select(*cat.CATALOG_COLUMNS).collect())) == want
