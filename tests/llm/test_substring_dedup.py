"""Operator 4 against a scan in corpus order, and its defined edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tidemark.llm import substring_dedup
from tidemark.llm.substring_dedup import SuffixAutomaton, op4_substring_dedup, remove_repeats


def brute(rows, length=20):
    seen, out = {}, []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - length + 1):
            place = (i is not None, i or 0, k)
            key = tuple(w[k:k + length])
            seen[key] = min(seen.get(key, place), place)
    for i, text in rows:
        w = (text or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k:k + length])] < (i is not None, i or 0, k):
                keep[k:k + length] = [False] * length
        left = b" ".join(x for x, ok in zip(w, keep, strict=True) if ok)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.sha) for r in df.collect()), key=str)


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    out = op4_substring_dedup(spark, SF001).withColumnRenamed("kept_sha256", "sha")
    assert got(out) == brute(rows)


@pytest.mark.parametrize("shard", [128, 3])
def test_shared_passages_and_hot_ones(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(40)}"
    common = [word() for _ in range(55)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if i % 3:
            cut = rng.randrange(0, 25)
            w += common[cut:cut + rng.randrange(15, 45)]
        w += [word() for _ in range(rng.randrange(0, 30))]
        rows.append((i, " ".join(w)))
    rows += [(100, rows[4][1]), (101, "a b " * 40), (102, "And " * 50), (103, rows[5][1] + " " + rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(remove_repeats(df)) == brute(rows)


def test_edge_cases(spark):
    p = " ".join(f"p{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, " \t "), (4, p), (5, "É " + p + " end"), (None, p + " x"), (6, "short"), (7, p), (7, p),
            (8, " ".join(f"l{k}" for k in range(60_000)) + " " + p)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, d string")
    assert got(remove_repeats(df)) == brute(rows)
    assert remove_repeats(df.limit(0)).count() == 0
    assert remove_repeats(df.where("doc_id in (1, 6)").withColumn("at", F.lit(1))).count() == 2


def test_matching_statistics():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 3, 30).tolist() for _ in range(5)]
    automaton = SuffixAutomaton()
    for t in texts[:4]:
        automaton.add(t)
    q = texts[4]
    for end, size in enumerate(automaton.matches(q)):
        found = [n for n in range(end + 2) if any(q[end + 1 - n:end + 1] == t[k:k + n] for t in texts[:4] for k in range(len(t)))]
        assert size == max(found)
