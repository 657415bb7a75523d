"""Repeated passages by suffix automata over shards of reference text (operator 4).

A word goes when a run of ``LENGTH`` words that covers it also starts earlier in the corpus. The
reference is the corpus itself, so no automaton of all of it could be broadcast; it is cut into
shards that bring together only text that can match:

1. Every run is keyed by its anchor, the smallest hash of an 8-word gram inside it: equal runs
   have equal anchors. Anchors that occur once are dropped (a count, then a bitmap of at most
   ``FILTER_BITS`` bits that may let a few too many through).
2. Runs of one place with one anchor form a region. Equal regions collapse to the first one; all
   later ones go whole.
3. The first regions of an anchor are its reference shard. A task streams them in corpus order
   through the suffix automaton of the earlier ones; matching statistics of ``LENGTH`` or more
   mark the runs that occurred before. Anchors with more than ``SHARD`` different regions (a
   passage in many contexts) are taken apart into their runs instead, whose first occurrences
   are a grouped minimum: exact as well, and pre-aggregated before the shuffle.

Words are 64-bit hashes; a run is only compared with runs of the same anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._common import (_BASE, U64, _powers, arrow_map, mix, rolling, sorted_groups, string_buffers, table,
                                  text_slices, word_hashes, written)

LENGTH = 20
GRAM = 8
SHARD = 128
#: Most bits of a broadcast filter (64 MB); beyond it the filter only lets more rows through.
FILTER_BITS = 1 << 29
_SLICES = 64
_PROBES = 4
_LOWEST = -(1 << 63)


def regions(h: np.ndarray, rows: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first run, number of runs, anchor hash, region hash) of each region of hashed words.

    ``rows`` holds the text of each word (ascending); positions are indices into ``h``.
    """
    width = length - GRAM + 1
    runs = len(h) - length + 1
    if runs <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2
    grams = rolling(h, GRAM)
    low = np.lib.stride_tricks.sliding_window_view(grams, width)
    anchor = low.argmin(axis=1) + np.arange(runs)
    inside = rows[:runs] == rows[length - 1:]
    first = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (rows[1:runs] != rows[:runs - 1])]))
    ends = np.flatnonzero(inside & np.concatenate(
        [(anchor[1:] != anchor[:-1]) | (rows[1:runs] != rows[:runs - 1]) | ~inside[1:], [True]]))
    count = ends - first + 1
    up, down = _powers(len(h))
    sums = np.concatenate([[U64(0)], np.cumsum(h * up)])
    body = (sums[ends + length] - sums[first]) * down[first]
    key = mix(body + count.astype(U64) * _BASE + mix((anchor[first] - first).astype(U64)))
    return first, count, grams[anchor[first]], key


class Filter:
    """A blocked bitmap of 64-bit keys: no key that was put in is ever missed."""

    def __init__(self, bits: int, slices: dict[int, bytes]):
        self.bits = bits // _SLICES
        self.map = np.zeros((_SLICES, self.bits // 8), np.uint8)
        for k, b in slices.items():
            self.map[k] = np.frombuffer(b, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
        return (mix(keys + U64(probe + 1) * _BASE) & U64(bits - 1)).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], U64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        own = (mix(keys) >> U64(58)).astype(np.int64)
        out = np.ones(len(keys), bool)
        for probe in range(_PROBES):
            at = self.places(keys, self.bits, probe)
            out &= (self.map[own, at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def build_filter(keys: DataFrame, count: int):
    """Broadcast filter of the 64-bit column ``key``; its slices are made by as many tasks."""
    bits = 1 << 16
    while bits < min(FILTER_BITS, 12 * count):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            own = (mix(k) >> U64(58)).astype(np.int64)
            for s in np.unique(own):
                m = maps.setdefault(int(s), np.zeros(bits // _SLICES // 8, np.uint8))
                for probe in range(_PROBES):
                    at = Filter.places(k[own == s], bits // _SLICES, probe)
                    np.bitwise_or.at(m, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for s, m in maps.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([m.tobytes()], pa.binary())], names=["slice", "bits"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((mix(k) >> U64(58)).astype(np.int64))],
                                             names=["key", "slice"])

    spread = arrow_map(keys.select("key"), slices, "key long, slice long").repartition(_SLICES, "slice")
    found: dict[int, bytes] = {}
    for r in arrow_map(spread.select("key"), run, "slice long, bits binary").toLocalIterator():
        old = found.get(r["slice"])
        new = bytes(r["bits"])
        found[r["slice"]] = new if old is None else bytes(np.frombuffer(old, np.uint8) | np.frombuffer(new, np.uint8))
    return keys.sparkSession.sparkContext.broadcast((bits, found))


def place_key(key: np.ndarray, d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of a region at a place of a document."""
    return mix(key + mix(d.view(U64) + mix(at.astype(U64) * _BASE)))


def _scan(mode: str, length: int, known=None):
    """Regions of each text: their anchors only, their places, or (for chosen ones) their words."""
    held: list[Filter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known is not None and not held:
            held.append(Filter(*known.value))
        for batch in text_slices(batches):
            data, offsets = string_buffers(batch.column(2))
            rows, _, _, h = word_hashes(data, offsets)
            first, count, anchor, key = regions(h, rows, length)
            if mode == "anchors":
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64))], names=["key"])
                continue
            d = batch.column(0).to_numpy(zero_copy_only=False)[rows[first]] if len(first) else np.zeros(0, np.int64)
            at = first - np.searchsorted(rows, rows[first]) if len(first) else first
            test = anchor if mode == "places" else place_key(key, d, at)
            pick = np.flatnonzero(held[0].has(test)) if len(test) else np.zeros(0, np.int64)
            out = [pa.array(anchor[pick].view(np.int64)), pa.array(key[pick].view(np.int64)), pa.array(d[pick]),
                   batch.column(1).take(pa.array(rows[first[pick]])), pa.array(at[pick].astype(np.int32)),
                   pa.array(count[pick].astype(np.int32))]
            names = ["anchor", "region", "d", "text_hash", "at", "runs"]
            if mode == "words":
                out.append(pa.array([h[a:a + n].tobytes() for a, n in
                                     zip(first[pick].tolist(), (count[pick] + length - 1).tolist(), strict=True)], pa.binary()))
                names.append("words")
            yield pa.RecordBatch.from_arrays(out, names=names)
    return run


_PLACES = "anchor long, region long, d long, text_hash long, at int, runs int"


class SuffixAutomaton:
    """Suffix automaton of several word sequences; one state for each set of equal end places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            if w in self.next[last]:
                q = self.next[last][w]
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
                continue
            new = self._state({}, self.size[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][w]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
            last = new

    def _state(self, edges: dict[int, int], size: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        copy = self._state(dict(self.next[q]), self.size[p] + 1)
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[int]) -> Iterator[int]:
        """Length of the longest match that ends at each word."""
        state = size = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            else:
                size = 0
            yield size


def _stream(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for group in sorted_groups(batches, ["anchor"]):
            if group.num_rows > 1:
                automaton = SuffixAutomaton()
                rows = zip(*[group.column(c).to_pylist() for c in ("d", "text_hash", "at", "words")], strict=True)
                for d, text, at, raw in rows:
                    words = np.frombuffer(raw, U64).tolist()
                    start = None
                    for end, size in enumerate(automaton.matches(words)):
                        run_at = end - length + 1
                        if size >= length and start is None:
                            start = run_at
                        elif size < length and start is not None:
                            out.append((d, text, at + start, at + end))
                            start = None
                    if start is not None:
                        out.append((d, text, at + start, at + len(words)))
                    automaton.add(words)
            if len(out) > 50_000:
                yield _intervals(out)
                out = []
        if out:
            yield _intervals(out)
    return run


def _intervals(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    d, text, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(text, pa.int64()), pa.array(a, pa.int32()),
                                       pa.array(b, pa.int32())], names=["d", "text_hash", "a", "b"])


_INTERVALS = "d long, text_hash long, a int, b int"


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = rolling(np.frombuffer(r["words"], U64), length)
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["anchor"]] * n, pa.int64()), pa.array(keys.view(np.int64)), pa.array([r["d"]] * n, pa.int64()),
                     pa.array([r["text_hash"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32) + r["at"])],
                    names=["anchor", "run", "d", "text_hash", "at"])
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()
            keep = np.ones(len(words), bool)
            for s in spans or ():
                keep[s["a"]:s["b"]] = False
            left = b" ".join([words[k] for k in np.flatnonzero(keep)])
            rows.append((len(words), int(len(words) - keep.sum()), left.decode(), hashlib.sha256(left).hexdigest()))
        n, gone, left, sha = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string()),
                                          pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "sha"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, text_hash, a, b): word spans of ``docs(d, text_hash, text)`` whose runs start earlier too."""
    known = written(arrow_map(docs, _scan("anchors", length), "key long").groupBy("key").count().where("count > 1").select("key"),
                    "anchors")
    places = written(arrow_map(docs, _scan("places", length, build_filter(known, known.count())), _PLACES), "places")
    firsts = written(places.groupBy("anchor", "region").agg(F.min(F.struct("d", "at")).alias("first"),
                                                            F.count(F.lit(1)).alias("n")), "regions")
    place = F.struct("d", "at")
    later = (places.join(firsts.where("n > 1").drop("n"), ["anchor", "region"]).where(place != F.col("first"))
             .select("d", "text_hash", F.col("at").alias("a"), (F.col("at") + F.col("runs") + length - 1).cast("int").alias("b")))
    shards = written(firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    chosen = firsts.drop("n").join(shards.select("anchor"), "anchor").select("region", "first.d", "first.at")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = place_key(b.column(0).to_numpy().view(U64), b.column(1).to_numpy(), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64))], names=["key"])

    wanted = written(arrow_map(chosen, keys, "key long"), "chosen")
    words = written(arrow_map(docs, _scan("words", length, build_filter(wanted, wanted.count())), _PLACES + ", words binary")
                    .join(shards, "anchor"), "words")
    streamed = arrow_map(words.where(F.col("n") <= SHARD).select("anchor", "d", "text_hash", "at", "words")
                         .repartition("anchor").sortWithinPartitions("anchor", "d", "at"), _stream(length), _INTERVALS)
    runs = written(arrow_map(words.where(F.col("n") > SHARD).select("anchor", "d", "text_hash", "at", "words"), _runs(length),
                             "anchor long, run long, d long, text_hash long, at int"), "runs")
    first_run = runs.groupBy("anchor", "run").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    apart = (runs.join(first_run, ["anchor", "run"]).where(place != F.col("first"))
             .select("d", "text_hash", F.col("at").alias("a"), (F.col("at") + length).cast("int").alias("b")))
    return later.union(streamed).union(apart)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: n_words, n_removed, kept (text) and its sha256.

    * Null and empty texts have no words; texts shorter than ``length`` words keep all.
    * A null doc_id counts as the smallest one. Rows that repeat a doc_id are one document:
      a run at the same place of both does not precede itself, one further on in either goes.
    * Very long texts are one row of a task, hashed piece by piece; extra columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("d"),
                       F.xxhash64("text").alias("text_hash"), "text")
    spans = (repeated_spans(rows.select("d", "text_hash", "text"), length)
             .groupBy("d", "text_hash").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    joined = rows.join(spans, ["d", "text_hash"], "left").select("doc_id", "text", "spans")
    return arrow_map(joined, _cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, "
                                   "kept string, sha string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all documents, as its contract states."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"))
