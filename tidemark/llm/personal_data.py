"""Personal data by weak supervision (operator 10).

Four fixed patterns give the base spans, which always stay. Further patterns propose candidates.
Five labelers vote on every span (yes, no or abstain): its format, a gazetteer, the words before
it, its shape and its borders. The vote patterns of the whole corpus are counted; expectation-
maximisation over these counts estimates how reliable each labeler is, and a logistic span
classifier is trained on the posteriors. Candidates it accepts are added. Counts have at most
kinds x 3^5 rows, whatever the size of the corpus, so the models are fitted on the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._common import arrow_map, table, text_slices, written

#: Base kinds first, in their order; the others are added by the method.
KINDS = ("email", "ip", "card", "phone", "local_phone", "spelled_email", "ssn", "iban", "name")
BASE = 4
NO, ABSTAIN, YES = 0, 1, 2
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MORE = {
    "local_phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "spelled_email": re.compile(r"\b[a-z0-9._]{2,40} ?[\[(]at[\])] ?[a-z0-9-]{2,40}(?: ?[\[(]dot[\])] ?[a-z]{2,10}|\.[a-z]{2,10})+", re.I | re.A),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", re.A),
}
#: Gazetteers: common first names, top-level domains and countries of IBANs.
NAMES = frozenset("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph "
                  "Jessica Thomas Sarah Charles Karen Daniel Nancy Anna Peter Paul Maria Hans Klaus Juan Carlos Luis Carmen "
                  "Pierre Jean Marie Sophie Claire Ahmed Fatima Wei Ivan Olga".split())
_MORE["name"] = re.compile(rf"\b(?=[A-Z])(?:{'|'.join(sorted(NAMES))}) [A-Z][a-z]{{2,20}}\b", re.A)
#: A text without these has no candidate of the kind; looked for first, because it is quick.
_NEEDS = {"local_phone": re.compile("[0-9]{4}"), "spelled_email": re.compile(r"[\[(]at[\])]", re.I), "ssn": re.compile("[0-9]{4}"),
          "iban": re.compile("[A-Z]{2}[0-9]{2}")}
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info co us ch at nl it".split())
COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail email e-mail contact write", "ip": "ip host server address from login", "card": "card visa mastercard credit pay",
    "phone": "call phone tel mobile fax contact", "local_phone": "call phone tel mobile fax contact",
    "spelled_email": "mail email e-mail contact write", "ssn": "ssn social security", "iban": "iban account bank transfer",
    "name": "name dear mr mrs ms dr contact signed regards",
}
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
AGAINST = frozenset("version release isbn order invoice ticket part section figure table page model serial chapter".split())


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds, by start, then kind."""
    out = []
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        low = at
        while low > last and (text[low - 1].isascii() and text[low - 1].isalnum() or text[low - 1] in "._%+-"):
            low -= 1
        m = _DOMAIN.match(text, at) if low < at else None
        if m:
            out.append((low, 0, m.end()))
            last = m.end()
        # The next sign is never left of here, so every character is looked at twice at most.
        at, last = (m.end(), last) if m else (at + 1, max(last, at + 1))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the other kinds that overlap neither a base span nor one of a kind before; the
    taken spans and a kind's matches are two sorted lists, walked once together."""
    out: list[tuple[int, int, int]] = []
    taken = _disjoint(sorted((a, b) for a, _, b in base))
    for k, kind in enumerate(KINDS[BASE:], BASE):
        if kind in _NEEDS and not _NEEDS[kind].search(text):
            continue
        free, at = [], 0
        for m in _MORE[kind].finditer(text):
            a, b = m.span()
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at == len(taken) or taken[at][0] >= b:
                free.append((a, b))
        if free:
            out += [(a, k, b) for a, b in free]
            taken = sorted(taken + free)
    return sorted(out)


def votes(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """The five labelers' votes on a span."""
    a, k, b = span
    kind, s = KINDS[k], text[a:b]
    digits = _digits(s)
    if kind == "iban":
        c = s.replace(" ", "")
        form = YES if int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1 else NO
    elif kind == "ssn":
        form = NO if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else YES
    elif kind == "card":
        form = YES if digits[0] in "3456" else NO
    elif kind == "email":
        form = YES if s[0].isalnum() and ".." not in s else NO
    elif kind == "name":
        form = ABSTAIN
    else:
        form = YES
    if kind in ("email", "spelled_email"):
        listed = YES if re.split(r"[^a-z]+", s.lower().rstrip(")]"))[-1] in DOMAINS else NO
    elif kind == "iban":
        listed = YES if s[:2] in COUNTRIES else NO
    elif kind == "name":
        listed = YES
    else:
        listed = ABSTAIN
    before = re.findall(r"[a-z-]+", text[max(0, a - 40):a].lower())[-4:]
    context = YES if _CUES[kind] & set(before) else NO if AGAINST & set(before) else ABSTAIN
    shape = ABSTAIN if not digits else NO if len(set(digits)) < 3 else YES
    left, right = text[a - 1:a], text[b:b + 1]
    border = NO if left.isalnum() or right.isalnum() else YES
    return form, listed, context, shape, border


def fit_labelers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, table class x labeler x vote) by expectation-maximisation."""
    p = np.clip(((patterns == YES).sum(axis=1) + 1) / ((patterns != ABSTAIN).sum(axis=1) + 2), 0.05, 0.95)
    table_ = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        prior = np.clip((p * counts).sum() / counts.sum(), 0.02, 0.98)
        for c, w in ((0, (1 - p) * counts), (1, p * counts)):
            for v in range(3):
                # Smoothing holds the labelers to be better than chance.
                table_[c, :, v] = (w[:, None] * (patterns == v)).sum(axis=0) + (2.0 if v == (YES if c else NO) else 1.0)
        table_ /= table_.sum(axis=2, keepdims=True)
        log = np.log(table_)
        score = [np.log(q) + sum(log[c, k, patterns[:, k]] for k in range(patterns.shape[1])) for c, q in ((0, 1 - prior), (1, prior))]
        p = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return p, table_


def features(kinds: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """One-hot kinds and votes, and a constant."""
    return np.concatenate([np.eye(len(KINDS))[kinds], *[np.eye(3)[patterns[:, k]] for k in range(patterns.shape[1])],
                           np.ones((len(kinds), 1))], axis=1)


def fit_classifier(x: np.ndarray, p: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic classifier of soft labels ``p`` (gradient descent with a ridge)."""
    w = np.zeros(x.shape[1])
    share = np.log1p(counts) / np.log1p(counts).sum()
    for _ in range(rounds):
        y = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (share * (y - p)) + 1e-3 * w)
    return w


_FOUND = "array<struct<start:int,kind:int,end:int,code:int>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])
    for batch in text_slices(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            found = []
            for s in base + candidates(text, base):
                code = 0
                for v in votes(text, s):
                    code = code * 3 + v
                found.append({"start": s[0], "kind": s[1], "end": s[2], "code": code})
            rows.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "found"])


def _votes_of(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(4, -1, -1)], axis=1)


def _finish(accepted: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = [], [], []
            for found in batch.column(1).to_pylist():
                found = sorted(found or (), key=lambda s: (s["start"], s["kind"]))
                name = {id(s): f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in found}
                base = [s for s in found if s["kind"] < BASE]
                counts.append([sum(s["kind"] == k for s in base) for k in range(BASE)])
                sha.append(hashlib.sha256(",".join(name[id(s)] for s in base).encode()).hexdigest())
                spans.append(",".join(name[id(s)] for s in found if s["kind"] < BASE or (s["kind"], s["code"]) in accepted))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: counts and digest of the base spans, all spans.

    Null and empty texts have none. Rows are taken one by one, so null and repeated ids keep
    their own results; long texts are read whole in linear time; extra columns are not read. An
    empty table, or one without any span, has nothing to fit and adds nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(arrow_map(docs.select("doc_id", "text"), _find, f"doc_id {kind}, found {_FOUND}"), "spans")
    counted = (found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.code").count()
               .orderBy("kind", "code").collect())
    accepted: frozenset = frozenset()
    if counted:
        kinds, codes, n = (np.array(x) for x in zip(*[tuple(r) for r in counted], strict=True))
        patterns = _votes_of(codes)
        p, _ = fit_labelers(patterns, n)
        x = features(kinds, patterns)
        told = 1 / (1 + np.exp(-(x @ fit_classifier(x, p, n))))
        accepted = frozenset((int(k), int(c)) for k, c, y in zip(kinds, codes, told, strict=True) if y >= 0.5)
    return arrow_map(found, _finish(accepted), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                                               "base_sha256 string, spans string")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents, as its contract states."""
    return find_personal_data(table(spark, sf_dir, "documents"))
