"""Operator 5: targets against direct water-filling, totals, limits, reruns and edge cases."""

from collections import defaultdict

import pytest

from conftest import SF01
from tidemark.llm.mixing import mix_sources, op5_mixing


def targets(sizes):
    """By repeated capping."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def check(docs, rows):
    words = defaultdict(int)
    for _, source, text in docs:
        words[source] += len((text or "").encode().split())
    want, got = targets(words), defaultdict(int)
    for r in rows:
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        got[r.source] += r.taken
    for s in words:
        assert abs(got[s] - want[s]) <= 1, s
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((i or -1, len((t or "").encode().split())) for i, _, t in docs)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "source", "text")
    rows = op5_mixing(spark, SF01).collect()
    check([tuple(r) for r in docs.collect()], rows)
    partial = sum(r.size and r.taken % r.size != 0 for r in rows)
    assert partial <= 20
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_hot_source_takes_several_levels(spark):
    docs = [(i, "hot" if i % 3 else f"s{i % 7}", "w " * (i % 11 + 1)) for i in range(1, 1500)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    check(docs, mix_sources(df).collect())


def test_edge_cases(spark):
    docs = [(1, None, "a b c"), (2, "é", None), (3, "z", ""), (4, "Z", " \t"), (5, "a", "x " * 50_000), (6, "a", "one"),
            (6, "a", "one"), (None, "b", "two words"), (8, "b", "three is one")]
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, source string, text string, target string")
    check(docs, mix_sources(df).collect())
    assert mix_sources(df.limit(0)).count() == 0
    blank = mix_sources(df.where("doc_id in (2, 3)")).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
