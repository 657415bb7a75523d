"""Operator 1 against all pairs of full shingle sets, and its defined edge cases."""

import numpy as np
import pytest

from conftest import SF001
from tidemark.llm.minhash_dedup import dedup_documents, near_duplicates, op1_minhash_dedup, superminhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op1_minhash_dedup(spark, SF001)) == brute(rows, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_large_group_of_near_copies_equals_all_pairs(spark, percent):
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(300):
        words = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            words[p] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"z{x}" for x in rng.integers(0, 10**6, 40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(near_duplicates(df, percent)) == brute(rows, percent)


def test_edge_cases(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "One two", "b"), (5, "one\ttwo ", "b"),
            (6, "two one", "c"), (7, long, "d"), (8, long + " end", "d"), (9, "one two", "x"), (9, "one two", "x"),
            (None, "one two", "y"), (10, "été one two three four", "z"), (11, "ÉTÉ one two three four", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, band string")
    out = near_duplicates(df)
    assert out.count() == len(rows)
    found = got(out.where("doc_id is not null"))
    assert found[1] == (0, 1, True) and found[2] == (0, 2, True) and found[3] == (0, 3, True)
    assert found[4] == (1, 4, True) and found[5] == (1, 4, False) and found[9] == (1, 4, False)
    assert found[6] == (1, 6, True) and found[7][1:] == (7, True) and found[8][1:] == (7, False)
    assert found[10][1] == 10 and found[11][1] == 11
    assert out.where("doc_id is null").first().kept
    left = dedup_documents(spark, df)
    assert left.columns == df.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 7, 10, 11]
    assert near_duplicates(df.limit(0)).count() == 0 and dedup_documents(spark, df.limit(0)).count() == 0
    twice = df.where("doc_id = 6").union(df.where("doc_id = 6"))
    assert near_duplicates(twice).count() == 2 and dedup_documents(spark, twice).count() == 1


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:1200])
    sig = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 1000), 2, 192)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.12
    small = superminhash(np.array([5], np.uint64), np.array([0]), 1, 192)
    assert len(set((small[0] >> np.uint64(40)).tolist())) == 192
