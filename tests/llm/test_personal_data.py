"""Operator 10: base spans against plain patterns over the whole table, the models, edge cases."""

import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings, strategies as st

from conftest import SF01
from tidemark.llm.personal_data import (_MORE, ABSTAIN, BASE, KINDS as ALL_KINDS, NO, YES, base_spans, candidates,
                                        find_personal_data, fit_labelers, op10_personal_data)

KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if max(map(int, m[0].split("."))) <= 255]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_whole_table_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = op10_personal_data(spark, SF01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        names = [f"{KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]
        assert [s for s in r.spans.split(",") if s.split(":")[0] in KINDS] == names
    assert sum(r.n_email for r in rows) and sum(r.n_phone for r in rows)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.Z9@-1+ 0(5)é%_", max_size=40))
def test_base_spans_equal_plain_patterns(text):
    assert base_spans(text) == plain(text)


def test_labelers_are_rated():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.55, 0.9])
    votes = np.where(rng.random((4000, 5)) < right, np.where(truth[:, None], YES, NO), np.where(truth[:, None], NO, YES))
    votes[rng.random((4000, 5)) < 0.3] = ABSTAIN
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, rates = fit_labelers(patterns, counts)
    assert ((p[at.ravel()] >= 0.5) == truth).mean() > 0.93
    strength = rates[1, :, YES] / (rates[1, :, YES] + rates[1, :, NO])
    assert strength[0] > strength[2] > strength[3]


def test_added_spans_and_edge_cases(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = [None, "", f"My IBAN account {iban} please.", "call (212) 555-0187 now", "ssn 123-45-6789", "mail joe [at] site [dot] com",
             "Contact Mary Miller today", "x@y.com 1.2.3.4 999.1.1.1; 4111 1111 1111 1111 +1 (437) 555-0689", "9" * 200_000,
             "a" * 200_000 + "@", "version 000-00-0000 serial"]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, texts[7], "n"), (7, texts[7], "m")]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans string")
    out = find_personal_data(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[0].spans == by[1].spans == by[8].spans == by[9].spans == "" and by[0].n_email == 0
    assert by[2].spans == f"iban:16:{16 + len(iban)}" and by[3].spans.startswith("local_phone") and by[4].spans.startswith("ssn")
    assert by[5].spans.startswith("spelled_email") and by[6].spans == "name:8:19"
    assert by[None].spans == by[7].spans and [by[7].n_email, by[7].n_ip, by[7].n_card, by[7].n_phone] == [1, 1, 1, 1]
    assert find_personal_data(df.limit(0)).count() == 0
    assert find_personal_data(df.where("doc_id < 2")).count() == 2


def test_added_candidates_equal_all_against_all():
    rng = random.Random(4)
    parts = ["James Smith", "a@b.com", "(555) 123-4567", "078-05-1120", "DE89 3704 0044 0532 0130 00", "mary at", "x [at] y.com", "+49 30 1234567", "é ",
             "4111 1111 1111 1111", "10.0.0.1", " ", "."]
    for _ in range(300):
        text = rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(1, 12)))
        base = base_spans(text)
        want, taken = [], [(a, b) for a, _, b in base]
        for k, kind in enumerate(ALL_KINDS[BASE:], BASE):
            for m in _MORE[kind].finditer(text):
                if not any(x < m.end() and m.start() < y for x, y in taken):
                    want.append((m.start(), k, m.end()))
                    taken.append(m.span())
        assert candidates(text, base) == sorted(want), text


def test_many_names_take_linear_time():
    at = time.perf_counter()
    text = "James Smith a@b.com, " * 150_000
    assert len(candidates(text, base_spans(text))) == 150_000
    assert time.perf_counter() - at < 20
