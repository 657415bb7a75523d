"""Operator 2: the whole-table query against its SQL, and its defined edge cases."""

import re

from conftest import SF001
from oracle_check import compare, duck
from tidemark.llm.decontamination import OP2_SQL, contamination, op2_decontamination, remove_contaminated


def test_whole_table_equals_sql(spark):
    problems, n = compare(op2_decontamination(spark, SF001), duck(SF001), OP2_SQL)
    assert not problems, problems
    assert n == 200


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for key, item in items:
        x = words(item)
        n = min(len(x), 10)
        grams = {tuple(x[k:k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k:k + n]) in grams:
                found.add(str(key))
                hit.update(range(k, k + n))
    return len(w), len(hit), sorted(found)


def test_edge_cases_equal_brute_force(spark):
    a = " ".join(f"Word{i}" for i in range(14))
    items = [(10, a), (9, a), (2, "Été, à PARIS!"), (3, None), (4, ""), (5, "!!"), (6, "solo"), (2, "other thing"),
             (7, "a a a a a a a a a a a")]
    texts = [None, "", " -- ", a.upper(), "x " + a + " y", "word0 word1", "été à paris", "ÉTÉ à paris", "solo", "other-thing SOLO",
             "a " * 30, " ".join(f"word{i}" for i in range(9)), "z " * 50_000 + a]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, a, "n"), (None, "clean", "n"), (8, "solo", "again"), (8, "free", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in contamination(docs, bench).collect()), key=str)
    want = sorted(((i, *brute(t, items)[:2], tuple(brute(t, items)[2])) for i, t, _ in rows), key=str)
    assert got == want
    left = remove_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == sum(not brute(t, items)[1] for _, t, _ in rows)
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0 and remove_contaminated(docs.limit(0), bench).count() == 0
