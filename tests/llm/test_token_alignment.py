"""Token alignment: whole texts encoded at once, links counted plainly, against the bitmap job."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SF001
from tidemark.llm import token_alignment as ta

SCHEMA = "doc_id long, text string"
ENC = ta.encoders(ta.FOLDER, ta.A_FILE, ta.B_FILE)
ODD = [None, "", " ", "x", "  two  spaces ", "tab\tand\nlines\n\n end", "it's we'll I'd", "<|endoftext|> </s> <unk> <s>", "a ▁ b", "no break 　 wide",
       "漢字 かな emoji 😀 👨‍👩‍👧 end", "É è ü ÿ × ÷ ß", "\x00 \x01 \x7f", "ﬁ ligature ½ Å", "a" * 3000, "1234 567,89 %$#@!()", "naïve café déjà", "  line \u0085 next"]


def plain(texts):
    """What the contract says, text by text over the whole encodings."""
    docs = []
    for text in texts:
        if not text:
            docs.append(None)
            continue
        raw = (" " + text).encode()
        a, b = ENC.encode(text)
        sides = [(a, [ENC.a_bytes[i] for i in a]), (b, [ENC.b_bytes[i] for i in b])]
        if any(b"".join(x) != raw for _, x in sides):
            docs.append(None)
            continue
        ends = [np.cumsum([len(x) for x in xs]).tolist() for _, xs in sides]
        links = [(x, y) for x, p in zip(a, ends[0], strict=True) for y, q in zip(b, ends[1], strict=True) if p == q] if len(a) < 400 else \
            [(a[ends[0].index(p)], b[ends[1].index(p)]) for p in sorted(set(ends[0]) & set(ends[1]))]
        groups, at = [], 0
        for p in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, es, strict=True) if at < e <= p) for (ids, _), es in zip(sides, ends, strict=True)))
            at = p
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for d in docs if d for x in d[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    rows = [(0, 0, 0, 0, 0, 0, "") if d is None else
            (d[0], d[1], d[2], len(d[3]), sum(count[x] == best[x[1]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs]
    return rows, count, Counter(x for d in docs if d for x in set(d[3]))


def result(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "Ab", "é", "漢", " ", "  ", "\n", "\t", "'s", "12", ".", "▁", " ", "😀", "<|endoftext|>", "the", "ÿ"]), max_size=14).map("".join))
def test_stretches_encode_as_their_text_does(text):
    whole_a, whole_b = ENC.encode(text) if text else ([], [])
    parts = [ENC.encode(s) for s in ENC.stretches(text)] if text else []
    assert [i for a, _ in parts for i in a] == whole_a and [i for _, b in parts for i in b] == whole_b


@pytest.mark.parametrize(("chunk_bytes", "chunk_docs", "batch"), [(16 << 20, 1 << 16, 4 << 20), (300, 5, 100)])
def test_documents_and_pairs_match_plain_counts(spark, chunk_bytes, chunk_docs, batch):
    rng = random.Random(3)
    words = ["the", "running", "dog's", "straße", "Über", "x1", "l'été", "(", "...", "tokenizer", "of"]
    texts = ODD + [rng.choice([" ", "\n", "  "]).join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["the the the"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(2)
    out = ta.align_tokenizers(df, chunk_docs=chunk_docs, chunk_bytes=chunk_bytes, batch_bytes=batch)
    rows, links, in_docs = plain(texts)
    assert result(out.documents) == rows
    assert {(r.a, r.b): (r.n_links, r.n_docs) for r in out.pairs.collect()} == {k: (n, in_docs[k]) for k, n in links.items()}


def test_given_documents_match_whole_encodings(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert result(ta.align_tokenizers(docs).documents) == plain(texts)[0]


@pytest.mark.parametrize("docs", [1, 9, 300, 65_536])
def test_bitmaps_and_planes_round_trip(docs):
    rng = np.random.default_rng(docs)
    want = Counter()
    for pair, share in enumerate((1.0, 0.5, 0.01, 0.0001)):
        for d in np.flatnonzero(rng.random(docs) < share).tolist():
            want[pair, d] = int(rng.integers(1, 40))
    want[7, docs - 1] = 1000
    keys = sorted(want)
    pair, doc = (np.array([k[i] for k in keys], dtype=np.int64) for i in (0, 1))
    got = Counter()
    for plane, pairs, dense, bits, ones in ta.bitmaps(pair, doc, np.array([want[k] for k in keys]), docs):
        row, number = ta.members(bits, dense)
        assert np.bincount(row, minlength=len(pairs)).tolist() == ones.tolist()
        for p, d in zip(pairs[row].tolist(), number.tolist(), strict=True):
            got[p, d] += 1 << max(plane - 1, 0)
        assert ta.members(pa.concat_arrays([bits, bits]).slice(len(bits)), dense)[1].tolist() == number.tolist()
    assert got == want


def test_repeated_rows_empty_tables_and_extra_columns(spark):
    rows = [(1, "one two", 5), (1, "one two", 5), (None, "one", 6), (2, None, 7)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_a int")
    out = ta.align_tokenizers(docs)
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in out.documents.collect()) == [(0, 1, 3), (1, 2, 5), (1, 2, 5), (2, 0, 0)]
    none = ta.align_tokenizers(docs.where(F.lit(False)))
    assert none.documents.collect() == [] and none.pairs.collect() == []
