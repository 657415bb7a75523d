"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

The network reads windows of ``WINDOW`` bytes in both directions, labels every byte position
and averages the position probabilities over the whole text. It is trained here, in numpy, by
backpropagation through time on a bounded sample of labelled rows (``per_language`` texts in
expectation for each language, ``most`` in all, one span of ``span`` characters each).
Prediction runs inside ``mapInArrow``: all windows of a slice of texts step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm._common import arrow_map, string_buffers, table, text_slices

WINDOW = 64
HIDDEN = 12
#: Windows that step together.
ROWS = 1024
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class ByteNetwork:
    """Two gated recurrent layers (left to right, right to left) and one linear layer."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["u" + d] = rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(3 * hidden, np.float32)
        self.p["v"] = rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32)
        self.p["o"] = np.zeros(len(labels), np.float32)

    def _step(self, d: str, byte: np.ndarray, h: np.ndarray) -> tuple:
        n = self.hidden
        x = self.p["x" + d][byte] + self.p["c" + d]
        u = h @ self.p["u" + d]
        gates = _sigmoid(x[:, :2 * n] + u[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(x[:, 2 * n:] + r * u[:, 2 * n:])
        return h + z * (new - h), z, r, new, u[:, 2 * n:]

    def states(self, x: np.ndarray, valid: np.ndarray, keep: bool = False) -> tuple:
        """States of both directions at every position; a state is zero where nothing is valid."""
        rows, steps = x.shape
        out = np.zeros((steps, rows, 2 * self.hidden), np.float32)
        tapes: dict[str, list] = {"f": [], "b": []}
        full = valid.all(axis=0)
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h = np.zeros((rows, self.hidden), np.float32)
            at = slice(0, self.hidden) if d == "f" else slice(self.hidden, None)
            for t in order:
                before = h
                h, *rest = self._step(d, x[:, t], before)
                if not full[t]:
                    h = h * valid[:, t, None]
                out[t][:, at] = h
                if keep:
                    tapes[d].append((t, before, *rest))
        return out, tapes

    def _fused(self) -> tuple[np.ndarray, ...]:
        """Weights for ``probabilities``: byte tables with their biases, (gate, direction, byte) by
        unit, and recurrent weights; update and reset are halved, for sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        n, p = self.hidden, self.p
        x = np.stack([p["x" + d] + p["c" + d] for d in "fb"])
        u = np.stack([p["u" + d] for d in "fb"])
        gates = np.stack([x[:, :, :n], x[:, :, n:2 * n]]) * 0.5
        own = np.stack([u[:, :, :n], u[:, :, n:2 * n]]) * 0.5
        return (np.ascontiguousarray(gates.reshape(-1, n)), np.ascontiguousarray(x[:, :, 2 * n:].reshape(-1, n)),
                np.ascontiguousarray(own), np.ascontiguousarray(u[:, :, 2 * n:]))

    def probabilities(self, x: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Label probabilities of every position, (steps, rows, labels).

        Both directions step together: one gather, one tanh for update and reset, one for the
        candidate, all into buffers made once. ``states`` is the plain form of the same.
        """
        rows, steps = x.shape
        n, kind = self.hidden, self.p["v"].dtype
        gate_table, table_, own, inner = self._fused()
        bytes_ = np.ascontiguousarray(x.T).astype(np.intp)
        at = np.empty((2, 2, rows), np.intp)
        zr, cand, h = np.empty((2, 2, rows, n), kind), np.empty((2, rows, n), kind), np.zeros((2, rows, n), kind)
        product, u = np.empty((2, 2, rows, n), kind), np.empty((2, rows, n), kind)
        states = np.empty((2, steps, rows, n), kind)
        full, ok = valid.all(axis=0), np.ascontiguousarray(valid.T).astype(kind)[:, :, None]
        for t in range(steps):
            back = steps - 1 - t
            at[0, 0] = bytes_[t]
            np.add(bytes_[back], 256, out=at[0, 1])
            np.add(at[0], 512, out=at[1])
            np.take(gate_table, at.reshape(-1), axis=0, out=zr.reshape(-1, n), mode="clip")
            np.take(table_, at[0].reshape(-1), axis=0, out=cand.reshape(-1, n), mode="clip")
            if t:
                for d in (0, 1):
                    np.matmul(h[d], own[0, d], out=product[0, d])
                    np.matmul(h[d], own[1, d], out=product[1, d])
                    np.matmul(h[d], inner[d], out=u[d])
                zr += product
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            if t:
                u *= zr[1]
                cand += u
            np.tanh(cand, out=cand)
            cand -= h
            cand *= zr[0]
            h += cand
            for d, place in ((0, t), (1, back)):
                if not full[place]:
                    h[d] *= ok[place]
                states[d, place] = h[d]
        s = states[0] @ self.p["v"][:n]
        s += states[1] @ self.p["v"][n:]
        s += self.p["o"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over the valid positions and its gradients, through time."""
        n = self.hidden
        states, tapes = self.states(x, valid, keep=True)
        s = states @ self.p["v"] + self.p["o"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        weight = valid.T.astype(np.float32) / max(1, valid.sum())
        rows = np.arange(len(y))
        loss = -float((np.log(s[:, rows, y] + 1e-9) * weight).sum())
        s[:, rows, y] -= 1
        s *= weight[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"] = np.tensordot(states, s, axes=([0, 1], [0, 1]))
        g["o"] = s.sum(axis=(0, 1))
        back = s @ self.p["v"].T
        for d in "fb":
            at = slice(0, n) if d == "f" else slice(n, None)
            u = self.p["u" + d]
            carry = np.zeros((len(y), n), np.float32)
            for t, before, z, r, new, un in reversed(tapes[d]):
                dh = (carry + back[t][:, at]) * valid[:, t, None]
                dn = dh * z * (1 - new * new)
                dz = dh * (new - before) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                dx = np.concatenate([dz, dr, dn], axis=1)
                carry = dh * (1 - z) + du @ u.T
                g["u" + d] += before.T @ du
                g["c" + d] += dx.sum(axis=0)
                np.add.at(g["x" + d], x[:, t], dx)
        return loss, g

    def fit(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray, steps: int = 200, rows: int = 144,
            rate: float = 0.015, seed: int = 5) -> ByteNetwork:
        """Adam over random batches of windows."""
        rng = np.random.default_rng(seed)
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(y), rows)
            _, g = self.gradients(x[pick], valid[pick], y[pick])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * min(1.0, 2 * (steps - step + 1) / steps)
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.99 * two[k] + 0.01 * v * v
                self.p[k] -= now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-6)
        return self


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into windows of WINDOW bytes: (text of each window, bytes, which are valid)."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[:-1][row] + nth * WINDOW
    left = offsets[1:][row] - at
    valid = np.arange(WINDOW)[None, :] < left[:, None]
    index = np.minimum(at[:, None] + np.arange(WINDOW), max(0, len(data) - 1))
    x = data[index] if len(row) else np.zeros((0, WINDOW), np.uint8)
    return row, np.where(valid, x, 0).astype(np.uint8), valid


def _teachable() -> Column:
    return (F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("text").isNotNull() & F.col("lang").isNotNull()


def training_sample(docs: DataFrame, per_language: int = 400, span: int = 640, most: int = 25_600) -> list[tuple[str, str]]:
    """Bounded (lang, span of text) sample; a row's hash decides, so reruns agree.

    Every language is learned: ``per_language`` rows of each in expectation, or ``most`` in all
    shared evenly, but one at least. The model itself has a weight per language.
    """
    rows = docs.where(_teachable())
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return []
    per = max(1, min(per_language, most // len(counts)))
    shares = [(r["lang"], min(10**6, 10**6 * per // r["count"] + 1)) for r in counts]
    told = docs.sparkSession.createDataFrame(shares, "lang string, _share long")
    chance = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"))
    start = F.pmod(F.xxhash64(F.lit("span"), F.col("doc_id").cast("string")), F.greatest(F.length("text") - span, F.lit(1)))
    rows = rows.select("lang", chance.alias("_chance"), F.substring("text", (start + 1).cast("int"), F.lit(span)).alias("span"))
    picked = rows.join(F.broadcast(told), "lang").where(F.pmod("_chance", F.lit(10**6)) < F.col("_share")).select("lang", "span")
    return sorted((r["lang"], r["span"]) for r in picked.collect())


def train(sample: list[tuple[str, str]], **fit) -> ByteNetwork | None:
    labels = sorted({lang for lang, _ in sample})
    spans = [text.encode() for _, text in sample]
    if not any(spans):
        return None
    data = np.frombuffer(b"".join(spans), np.uint8)
    offsets = np.cumsum([0, *map(len, spans)])
    row, x, valid = windows(data, offsets)
    y = np.array([labels.index(lang) for lang, _ in sample])[row]
    return ByteNetwork(labels).fit(x, valid, y, **fit)


def _predict(model: ByteNetwork | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            data, offsets = string_buffers(batch.column(1))
            n = batch.num_rows
            k = len(model.labels) if model else 1
            total, hits = np.zeros((n, k)), np.zeros((n, k), np.int64)
            if model:
                row, x, valid = windows(data, offsets)
                for a in range(0, len(row), ROWS):
                    own, ok = row[a:a + ROWS], valid[a:a + ROWS]
                    p = model.probabilities(x[a:a + ROWS], ok)
                    label = p.argmax(axis=2)
                    label[~ok.T] = k
                    p *= ok.T[:, :, None]
                    np.add.at(total, own, p.sum(axis=0, dtype=np.float64))
                    # One count of (window, label) pairs; positions beyond a text count as label k.
                    pairs = np.bincount((label + np.arange(len(own)) * (k + 1)).ravel(), minlength=len(own) * (k + 1))
                    np.add.at(hits, own, pairs.reshape(len(own), k + 1)[:, :k])
            total /= np.maximum(np.diff(offsets), 1)[:, None]
            best = total.argmax(axis=1)
            letters = [bool(t) and any(map(str.isalpha, t)) for t in batch.column(1).to_pylist()]
            known = np.array(letters, dtype=bool) & (model is not None)
            share = hits[np.arange(n), best] / np.maximum(np.diff(offsets), 1)
            names = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)] if model else [UNKNOWN] * n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()),
                 pa.array(np.where(known, np.clip(total[np.arange(n), best], 0, 1), 0.0)),
                 pa.array(np.where(known, share, 0.0))],
                names=["doc_id", "lang_pred", "score", "position_share"])
    return run


def identify(docs: DataFrame, model: ByteNetwork | None, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score and the share of positions so labelled.

    Null texts and texts without a letter are ``und`` with score 0, as is every text when there
    was nothing to learn from. Equal label sums go to the first label in code-point order; repeated
    rows and null keys are told one by one; an empty table gives none. Very long texts are read whole, a slice of windows at a time.
    Only the key and the text are read, so other columns may have any names.
    """
    return arrow_map(docs.select(F.col(key).alias("doc_id"), "text"), _predict(model),
                     f"doc_id {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, "
                     "position_share double").withColumnRenamed("doc_id", key)


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows of ``docs`` whose language is told with a score of ``least`` or more; ``und`` goes, and
    ``lang`` becomes the language told.

    The whole row travels through the labelling, so repeated and null ids need no join.
    """
    model = train(training_sample(docs))
    predict = _predict(model)
    names = docs.columns
    at, lang_at = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            pair = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], names=["doc_id", "text"])
            told = pa.concat_tables([pa.Table.from_batches([b]) for b in predict([pair])])
            score = told.column("score").to_numpy()
            ok = (score >= least) & (np.array(told.column("lang_pred").to_pylist(), dtype=object) != UNKNOWN)
            label = told.column("lang_pred").combine_chunks().cast(batch.schema.field(lang_at).type)
            yield batch.set_column(lang_at, batch.schema.field(lang_at), label).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all documents, as its contract states."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(training_sample(docs)))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "position_share")
