"""Quality rules: counts against plain Python, the defined cases, and the pass that keeps rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality_rules import COVERAGE, keep_good, quality_rules

SCHEMA = "doc_id long, text string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or ""))}
    for n in (3, *COVERAGE):
        runs = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        often = {r for r, c in Counter(runs).items() if c > 1}
        hit = {i + k for i, r in enumerate(runs) if r in often for k in range(n)}
        if n == 3:
            out["n_repeat_words"] = len(hit)
        else:
            out[f"repeat_chars_{n}"] = sum(len(words[i]) for i in hit)
    seen, lines, dups, chars = set(), 0, 0, 0
    for line in (text or "").split("\n"):
        inside = re.findall(r"[^\x20\x09-\x0D]+", line)
        if inside:
            lines += 1
            if line in seen:
                dups += 1
                chars += sum(map(len, inside))
            seen.add(line)
    return out | {"n_lines": lines, "n_dup_lines": dups, "dup_line_chars": chars}


def test_counts_match_plain_python(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "a\nb\n a\na\n\na ", "# $ <>|x*&%"]
    for size in (4, 12, 60, 300, 3000):
        for vocabulary in (2, 9, 400):
            texts.append("".join(rng.choice("aéß漢z") * rng.randint(1, 3) + str(rng.randrange(vocabulary)) + rng.choice([" ", " ", "\n", " ", "\r\n"])
                                 for _ in range(size)))
    block = " ".join(f"w{i}" for i in range(11))
    texts += [block + " x " + block + " y " + block[:20], "same line here\n" * 40]
    got = {r.doc_id: r.asDict() for r in quality_rules(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = plain(text)
        assert {k: got[i][k] for k in want} == want, text
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        good = (100 * want["n_dup_lines"] <= 30 * want["n_lines"] and 100 * want["dup_line_chars"] <= 20 * want["word_chars"]
                and all(100 * want[f"repeat_chars_{n}"] <= p * want["word_chars"] for n, p in COVERAGE.items()))
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed and good)


@pytest.mark.parametrize("size", [60, 400])
def test_a_clean_text_stays_and_a_repetitive_one_goes(spark, size):
    clean = " ".join(f"word{i}" for i in range(size))
    paragraph = " ".join(f"again{i}" for i in range(size // 6))
    docs = spark.createDataFrame([(1, clean, "x"), (2, clean + " " + paragraph + " and " + paragraph, "y"), (3, None, None)],
                                 SCHEMA + ", word_chars string")
    kept = keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(docs).collect()} == {1: (False, True), 2: (False, False), 3: (True, False)}


def test_repeated_rows_empty_tables_and_long_texts(spark):
    long = " ".join(f"w{i % 70001}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long, 7), (1, long, 8), (None, "x", 9)], SCHEMA + ", n_words long")
    rows = quality_rules(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == [(0, 1), (1, 300_000), (1, 300_000)]
    assert all(r.repeat_chars_10 == r.word_chars for r in rows if r.doc_id)
    none = quality_rules(docs.where(F.lit(False)))
    assert none.collect() == [] and none.columns[0] == "doc_id"
