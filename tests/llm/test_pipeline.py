"""The pipeline stage by stage against brute force on its own input, and on odd rows."""

import re

import corpus_pipeline
from conftest import SF001
from test_decontamination import brute as leaks
from test_minhash_dedup import brute as groups
from test_mixing import check
from test_secrets import base

from tidemark.llm._common import table, written


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_each_stage_on_its_input(spark):
    docs = table(spark, SF001, "documents")
    items = rows(table(spark, SF001, "benchmark").withColumnRenamed("item_id", "doc_id"))
    columns = docs.columns
    given = rows(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF001), name)
        if name == "mix":
            texts = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
            got = out.collect()
            taken = {r.doc_id for r in got}
            assert taken <= {i for i, _, _ in texts} and all(r.taken > 0 for r in got)
            break
        assert out.columns == columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        left = rows(out)
        if name == "language_id":
            assert sorted(left) == sorted(r for r in given if r[1] and any(map(str.isalpha, r[1])))
        elif name == "near_dedup":
            want = groups(given, 80)
            assert sorted(i for i, _ in left) == sorted(i for i in want if want[i][2])
        elif name == "decontaminate":
            assert sorted(left) == sorted(r for r in given if not leaks(r[1], items)[1])
        elif name == "redact":
            assert sorted(i for i, _ in left) == sorted(i for i, _ in given)
            assert not any(base(t) for _, t in left)
            assert all(a == b for a, b in zip(sorted(left), sorted(given), strict=True) if not base(b[1]) and "[SECRET]" not in a[1])
        docs, given = out, left
    full = corpus_pipeline.run(spark, SF001)
    assert sorted((r.doc_id, r.taken) for r in full.collect()) == sorted((r.doc_id, r.taken) for r in got)
    check(texts, mixed(spark, docs))


def mixed(spark, docs):
    from tidemark.llm.mixing import mix_sources
    return mix_sources(docs).collect()


def test_odd_rows_go_through_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, band string, a long"
    good = " ".join(f"word{i} and" for i in range(30))
    odd = [(1, None, "en", "s", None, "x", 1), (2, "", None, None, 0, None, None), (3, good, "en", "s", 9, "x", 1),
           (3, good, "en", "s", 9, "x", 1), (None, good + " tail", None, None, None, None, None),
           (4, "token = abcdefgh12 more words here now", "en", None, 30, "y", 2), (5, "x " * 30_000, "fr", "s", 60_000, "z", 3)]
    docs = spark.createDataFrame(odd, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF001), name)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    left = docs.collect()
    assert sorted(str(r.doc_id) for r in left) == ["3", "4", "5", "None"]
    assert next(r for r in left if r.doc_id == 4).text.startswith("[SECRET] more")
    assert re.fullmatch("(x )+", next(r for r in left if r.doc_id == 5).text)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF001).count() > 0
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SF001), name)
        assert empty.count() == 0
