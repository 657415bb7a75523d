"""Spelling variants: the index and the whole job against brute force, small shards, hot halves."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(docs, least=3):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(sv.UPPER, sv.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    out, form = {}, {}
    for w in n:
        others = sorted((v for v in n if near(v, w)), key=lambda v: (-n[v], v))
        form[w] = others[0] if others and n[others[0]] >= 2 * n[w] else None
        out[w] = (n[w], len(others))
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, *out[w], n.get(form[w])))
    return sorted(rows, key=str)


def result(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


@pytest.mark.parametrize(("letters", "count", "low", "high"), [("ab", 400, 1, 9), ("abcé", 600, 3, 8), ("abcdefghijklmnopéèßÿ", 300, 5, 7)])
def test_both_schemes_find_every_word_one_edit_away(letters, count, low, high):
    rng = random.Random(count)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(count)}
    words = sorted(words | {w[:2] + rng.choice(letters) + w[3:] for w in words})
    index = sv.BidirectionalIndex(words)
    asked = [*words, "zz", "a" * 30, "xa"]
    cuts = np.array([len(w) // 2 for w in asked])
    for left in (True, False):
        q, t = index.near(asked, cuts, left)
        got = {(asked[a], words[b]) for a, b in zip(q.tolist(), t.tolist(), strict=True)}
        want = {(a, b) for a in asked for b in words if near(a, b)
                and (b.startswith(a[:len(a) // 2]) if left else b.endswith(a[len(a) // 2:]))}
        assert got == want


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeiouéstrn") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["prefix" + x for x in "abcdefgh"]

    def spoil(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1:], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1:], w.upper(), w.capitalize()])
    return [(i, " ".join(spoil(rng.choice(base[:1 + rng.randrange(len(base))])) for _ in range(300))) for i in range(40)]


@pytest.mark.parametrize("shard", [50_000, 60, 7])
def test_whole_job_matches_brute_force_whatever_the_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(sv, "SHARD", shard)
    monkeypatch.setattr(sv, "TOGETHER", 500)
    docs = corpus(shard) + [(100, None), (101, ""), (102, "12 !? ×÷"), (None, "vanishing vanishing vanishing"), (103, "É" * 5000), (3, "again again again again")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = result(sv.spelling_variants(df.repartition(3)))
    assert got == plain(docs) and any(r[1] for r in got)


def test_forms_lead_to_the_last_root_and_ties_to_the_smallest(spark):
    texts = {"house": 40, "houses": 20, "housess": 10, "housesss": 5, "grate": 8, "crate": 8, "irate": 4, "lonely": 3, "brate": 3}
    rows = [(1, " ".join([w] * n)) for w, n in texts.items()]
    # The checksum may take a letter from a run; a doc_id where it takes none.
    free = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in texts))
    out = {r.word: r for r in sv.spelling_variants(spark.createDataFrame([(free, t) for _, t in rows], SCHEMA)).collect()}
    assert [out[w].root for w in ("house", "houses", "housess", "housesss")] == ["house"] * 4
    assert (out["irate"].form, out["irate"].form_n, out["irate"].n_near) == ("crate", 8, 3)
    assert out["grate"].form is None and out["crate"].root == "crate" and out["lonely"].n_near == 0


def test_empty_tables_and_extra_columns(spark):
    schema = SCHEMA + ", word string, n long, form string"
    docs = spark.createDataFrame([(1, "Étage étage ETAGE etage etage", "w", 1, "f")] * 2, schema)
    assert result(sv.spelling_variants(docs)) == plain([(1, "Étage étage ETAGE etage etage")] * 2)
    assert sv.spelling_variants(docs.where(F.lit(False))).collect() == []
    assert sv.spelling_variants(docs.withColumn("text", F.lit(None).cast("string"))).columns == ["word", "form", "root", "n", "n_near", "form_n"]
