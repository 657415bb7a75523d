"""Operator 7 against all pairs, recall at the threshold, and its defined edge cases."""

import numpy as np
import pytest

from conftest import SF01
from tidemark.llm import embedding_dedup
from tidemark.llm.embedding_dedup import bucket_keys, bucket_plan, bucket_probes, bucket_tables, near_vectors, op7_embedding_dedup, rotate


def brute(rows, cosine=0.9):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[k], *label[hit[k]]]) for k in range(len(ids))])
        if (new == label).all():
            return {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, hit.sum(axis=1), label, strict=True)}
        label = new


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(op7_embedding_dedup(spark, SF01)) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=(2, 600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for hashes in (4, 5):
        a, b = bucket_keys(x, hashes), bucket_keys(y, hashes)
        met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
        assert met.mean() >= 0.98
    assert np.allclose(np.linalg.norm(rotate(x, 3), axis=1), 1)


def test_large_group_in_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=32)
    rows = [(i, (base + rng.normal(scale=0.24, size=32)).tolist()) for i in range(700)]
    rows += [(1000 + i, rng.normal(size=32).tolist()) for i in range(50)]
    want, found = brute(rows), got(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)))
    assert sum(n for n, _, _ in found.values()) >= 0.98 * sum(n for n, _, _ in want.values())
    assert all(found[i][0] <= want[i][0] for i in want)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.3, 0.1, -0.2]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 1.0, 0.0]),
            (7, v), (8, v), (8, v), (9, [2 * c for c in v]), (10, [-c for c in v]), (11, [0.3, 0.1]), (None, v), (12, [1e300, 1e299, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, root int")
    out = near_vectors(df).collect()
    assert len(out) == len(rows)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    for i in (1, 2, 3, 4, 5, 6, 10, 11, 12):
        assert found[i] == (0, i, True)
    assert found[7] == (3, 7, True) and found[8] == (3, 7, False) and found[9] == (3, 7, False)
    assert found[None] == (0, None, True)
    assert near_vectors(df.limit(0)).count() == 0


def pairs_at(width, n=600, cosine=0.9):
    x, z = np.random.default_rng(3).normal(size=(2, n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z, axis=1, keepdims=True)


@pytest.mark.parametrize("width", [32, 64])
@pytest.mark.parametrize("hashes", range(1, 9))
def test_recall_for_every_hash_count(width, hashes):
    x, y = pairs_at(width)
    tables, probes = bucket_tables(hashes, width), bucket_probes(hashes)
    a, b = bucket_keys(x, hashes, tables, probes), bucket_keys(y, hashes, tables, probes)
    met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.98


def test_plan_grows_with_the_table():
    plans = [bucket_plan(n, 64) for n in (30_000, 1_000_000, 50_000_000)]
    assert [h for h, _, _ in plans] == [5, 6, 7]
    assert plans[0][1] < plans[1][1] < plans[2][1] and plans[0][2] < plans[1][2] < plans[2][2]
    assert bucket_plan(10, 1)[0] > 0 and bucket_plan(0, 3)[0] > 0


def test_links_with_more_hashes(spark):
    x, y = pairs_at(64, 300, 0.905)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    out = got(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), hashes=7))
    assert sum(out[i + 300][1] == i for i in range(300)) >= 0.98 * 300


def test_repeated_ids_with_different_vectors(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 32))
    rows = [(5, x), (5, y), (7, x), (9, y + 0.01 * rng.normal(size=32)), (11, x + 0.01 * rng.normal(size=32)), (13, rng.normal(size=32))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    assert out == [(5, 1, 5, True), (5, 2, 5, True), (7, 2, 5, False), (9, 1, 5, False), (11, 2, 5, False), (13, 0, 13, True)]


def test_topics_without_links(spark):
    rng = np.random.default_rng(6)
    topics = rng.normal(size=(8, 64))
    rows = [(i, (topics[i % 8] + 0.75 * rng.normal(size=64)).tolist()) for i in range(1600)]
    rows += [(2000 + i, (np.array(rows[i][1]) + 0.02 * rng.normal(size=64)).tolist()) for i in range(0, 1600, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    assert got(near_vectors(df)) == brute(rows)


def test_keys_of_a_vector_do_not_grow_with_the_table(spark, monkeypatch):
    plans, keys = [], embedding_dedup._keys
    monkeypatch.setattr(embedding_dedup, "_keys", lambda *plan: plans.append(plan) or keys(*plan))
    rng = np.random.default_rng(8)
    for n in (200, 1000):
        rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 64)))]
        assert near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == n
    plans += [embedding_dedup.work_plan(lambda k: n / 128**k, n, 64) for n in (10_256, 51_282)]
    assert all(tables * probes <= 20 for _, tables, probes in plans) and len(set(plans)) == 1
    large = embedding_dedup.work_plan(lambda k: 1e6 / 128**k, 1_000_000, 64)
    assert large[0] == 2 and large[1] * large[2] <= 60
    # Vectors that lean together get more hashes, copies of one another do not.
    assert embedding_dedup.work_plan(lambda k: 20_000 / 10**k, 50_000, 64)[0] == 2
    assert embedding_dedup.work_plan(lambda k: 20_000, 50_000, 64)[0] == 1


@pytest.mark.parametrize("hashes, probes", [(1, 3), (2, 6)])
def test_pairs_that_meet_often_count_once(spark, monkeypatch, hashes, probes):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))]
    rows += [(400 + i, (np.array(rows[i][1]) + 0.1 * rng.normal(size=6)).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert got(near_vectors(df, tables=12, probes=probes, hashes=hashes)) == brute(rows)


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_near_pairs_meet(hashes):
    x, y = pairs_at(64)
    probes = embedding_dedup.near_probes(hashes)
    tables = bucket_tables(hashes, 64, probes=probes, recall=embedding_dedup.MEET, least=1)
    a, b = bucket_keys(x, hashes, tables, probes), bucket_keys(y, hashes, tables, probes)
    met = (a == b[:, :, :1]).any(axis=(1, 2)) | (b == a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.995
