"""Operator 3: gradients against differences, held-out accuracy, and its defined edge cases."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from tidemark.llm.language_id import (ByteNetwork, identify, keep_identified, op3_language_id, train,
                                      training_sample, windows)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = ByteNetwork(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 256, (4, 7)).astype(np.uint8)
    valid = np.ones((4, 7), bool)
    valid[1, 4:] = False
    y = np.array([0, 2, 1, 1])
    _, g = net.gradients(x, valid, y)
    for k in ("uf", "ub", "cf", "cb", "v", "o", "xf"):
        i = (int(x[0, 0]), 1) if k == "xf" else tuple(np.array(net.p[k].shape) // 2)
        old, eps = net.p[k][i], 1e-3
        net.p[k][i] = old + eps
        up = net.gradients(x, valid, y)[0]
        net.p[k][i] = old - eps
        down = net.gradients(x, valid, y)[0]
        net.p[k][i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 2e-3 * max(1.0, abs(g[k][i])), k


def test_windows_cover_every_byte_once():
    texts = [b"", b"x" * 64, b"y" * 130, b"z"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    row, x, valid = windows(data, np.cumsum([0, *map(len, texts)]))
    assert [b"".join(bytes(x[k][valid[k]]) for k in np.flatnonzero(row == i)) for i in range(4)] == texts


def test_held_out_accuracy_over_the_whole_table(spark):
    out = op3_language_id(spark, SF01)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    sample = training_sample(docs)
    assert sample == training_sample(docs.repartition(7))
    model = train(sample, steps=20)
    rows = [(1, None, "en"), (2, "", None), (3, "12 34 !!", "en"), (None, "the and of", "en"), (5, "é", "fr"),
            (5, "é", "fr"), (7, "and the " * 40_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = identify(df, model).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].score == 0
    assert by[None].lang_pred in model.labels and by[7].lang_pred in model.labels
    assert identify(df, None).where("lang_pred != 'und'").count() == 0
    assert identify(df.limit(0), model).count() == 0
    one = docs.limit(40).withColumn("lang", F.lit(None).cast("string"))
    assert training_sample(one) == [] and train([]) is None
    few = docs.where("doc_id < 60").unionByName(docs.where("doc_id < 2").withColumn("text", F.lit("12 ? 3")))
    kept = keep_identified(few)
    assert kept.columns == docs.columns and kept.count() == docs.where("doc_id < 60").count()
    assert keep_identified(docs.limit(0)).count() == 0


def test_probabilities_equal_a_plain_loop():
    """Byte by byte over one window at a time, with the gate equations written out."""
    rng = np.random.default_rng(2)
    net = ByteNetwork(["a", "b", "c"], hidden=5)
    for k in net.p:
        net.p[k] = rng.normal(0, 0.7, net.p[k].shape).astype(np.float32)
    x = rng.integers(0, 256, (9, 13)).astype(np.uint8)
    valid = np.ones((9, 13), bool)
    valid[2, 6:] = valid[5, 1:] = valid[8, :] = False
    got = net.probabilities(np.where(valid, x, 0).astype(np.uint8), valid)

    def sigmoid(v):
        return 1 / (1 + np.exp(-v))

    for row in range(9):
        size = int(valid[row].sum())
        seen = {}
        for d, order in (("f", range(size)), ("b", range(size - 1, -1, -1))):
            h = np.zeros(5)
            for t in order:
                xs, u = net.p["x" + d][x[row, t]] + net.p["c" + d], h @ net.p["u" + d].astype(float)
                z, r = sigmoid(xs[:5] + u[:5]), sigmoid(xs[5:10] + u[5:10])
                h = (1 - z) * h + z * np.tanh(xs[10:] + r * u[10:])
                seen[d, t] = h
        for t in range(size):
            e = np.exp(np.concatenate([seen["f", t], seen["b", t]]) @ net.p["v"] + net.p["o"])
            assert np.allclose(got[t, row], e / e.sum(), atol=1e-5)


def test_every_language_is_learned(spark):
    rows = [(4 * k + i, f"text {chr(97 + k % 26) * 5} {k}", f"l{k:03}") for k in range(100) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({lang for lang, _ in training_sample(docs)}) == 100
    few = training_sample(docs, most=100)
    assert few == training_sample(docs.repartition(3), most=100) and len(few) < 400


def test_the_pipeline_goes_on_with_the_language_told(spark, monkeypatch):
    """The network decides which rows stay and what later stages read as ``lang``."""
    import corpus_pipeline
    from tidemark.llm import language_id

    words = {"en": "the cat and the dog went home with them", "de": "der hund und die katze sind nach hause gegangen"}
    rows = [(i, f"{words[lang]} {i}", lang, "s") for i in range(60) for lang in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    unlabelled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.col("lang")))
    assert unlabelled.where("lang is null").count() > 5
    kept = corpus_pipeline.language_id(spark, unlabelled, "").collect()
    want = {i: lang for i, _, lang, _ in rows}
    assert len(kept) == 60 and sum(r.lang == want[r.doc_id] for r in kept) >= 54

    class Unsure(ByteNetwork):
        def probabilities(self, x, valid):
            return np.full((x.shape[1], x.shape[0], 3), 1 / 3, np.float32)

    monkeypatch.setattr(language_id, "train", lambda sample: Unsure(["a", "b", "c"], hidden=2))
    assert corpus_pipeline.language_id(spark, docs, "").count() == 0
    assert keep_identified(docs).count() == 60
