"""Near-duplicate documents by SuperMinHash, banding, verification and union-find (operator 1).

A document is the set of its distinct 5-word shingles, each a 64-bit hash. Equal sets fall into
one class, and only one representative of a class goes on. SuperMinHash gives every shingle a
random permutation of the signature positions; its j-th rank goes to the j-th position of that
permutation, and ranks are handed out level by level, all shingles of a batch at once, until
every position holds a rank below the next level (the early stop). Bands of the signature make
buckets; within a bucket each member is tied to the smallest one, and the components of these
ties bound where links can be. Inside a component the full sets are compared exactly, in blocks
of at most ``BLOCK`` documents on average, so no task holds a whole group and no list of pairs
is made: a block returns a spanning forest of its links, found by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._common import (U64, arrow_map, mix, rolling, sorted_groups, string_buffers, table,
                                  text_slices, word_hashes, written)
from tidemark.llm.components import connected_components

WORDS = 5
#: Rows and number of bands by least similarity in percent: a pair at the threshold shares no
#: band with a probability of about 3e-7 (85) and 6e-7 (80).
BANDS = {85: (6, 32), 80: (5, 36)}
BLOCK = 64
_LEVEL = 40
_C = U64(0xD1342543DE82EF95)


def _times(n: int) -> np.uint64:
    return U64(n * int(_C) & 0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    rows, _, _, h = word_hashes(data, offsets, lower=True)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    roll = rolling(h, words)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        n = b - a
        if n >= words:
            out.append(np.unique(roll[a:b - words + 1]))
        elif n:
            out.append(mix(rolling(h[a:b], int(n)) + _times(int(n))))
        else:
            out.append(np.zeros(0, U64))
    return out


def _draw(h: np.ndarray, level: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Swap partner in [level, m) and rank in [level, level + 1) of each shingle."""
    r = mix(h + _times(level + 1))
    k = U64(level) + (((r >> U64(32)) * U64(m - level)) >> U64(32))
    return k.astype(np.int64), (U64(level) << U64(_LEVEL)) | (r & U64((1 << _LEVEL) - 1))


def superminhash(h: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Signatures (docs x m) of the sets whose members ``h`` belong to ``doc`` (ascending)."""
    sig = np.full(docs * m, np.iinfo(U64).max, dtype=U64)
    k, rank = _draw(h, 0, m)
    np.minimum.at(sig, doc * m + k, rank)
    present = np.zeros(docs, dtype=bool)
    present[doc] = True

    def unfinished(level: int) -> np.ndarray:
        return present & (sig.reshape(docs, m).max(axis=1) >= (U64(level) << U64(_LEVEL)))

    keep = unfinished(1)[doc]
    h, doc, k = h[keep], doc[keep], k[keep]
    order = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(h), 1))
    at = np.arange(len(h))
    order[at, 0], order[at, k] = k, 0
    for level in range(1, m):
        if not len(h):
            break
        k, rank = _draw(h, level, m)
        here, there = order[at, level], order[at, k]
        order[at, k] = here
        order[at, level] = there
        np.minimum.at(sig, doc * m + there, rank)
        keep = unfinished(level + 1)[doc]
        if not keep.all():
            h, doc, order = h[keep], doc[keep], order[keep]
            at = np.arange(len(h))
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit bucket key for each band of each signature."""
    s = sig[:, :rows * bands].reshape(len(sig), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=U64) * _C, (len(sig), 1))
    for k in range(rows):
        out = mix(out * _C + s[:, :, k])
    return out


def _signatures(rows: int, bands: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = string_buffers(batch.column(1))
            sets = shingle_sets(data, offsets, words)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            h = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), sizes)
            keys = band_keys(superminhash(h, doc, len(sets), rows * bands), rows, bands)
            sums = np.concatenate([[U64(0)], np.cumsum(mix(h + _C))])
            other = np.concatenate([[U64(0)], np.cumsum(mix(h ^ _C))])
            cut = np.concatenate([[0], np.cumsum(sizes)])
            full = sizes > 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(sets) + 1, dtype=np.int32) * bands),
                pa.array(keys.ravel().view(np.int64)), mask=pa.array(~full))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes),
                 pa.array((sums[cut[1:]] - sums[cut[:-1]]).view(np.int64)),
                 pa.array((other[cut[1:]] - other[cut[:-1]]).view(np.int64)), lists],
                names=["doc_id", "n_shingles", "f1", "f2", "bands"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, offsets = string_buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in shingle_sets(data, offsets, words)], pa.binary())],
                names=["node", "members"])
    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets (of one list with itself)."""
    sets = left if right is None else left + right
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    width = 4096
    out = np.zeros((len(left), len(sets) if right is None else len(right)), dtype=np.int64)
    top = int(column[-1]) + 1 if len(column) else 0
    cuts = np.searchsorted(column, np.arange(0, top + width, width))
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[row[a:b], column[a:b] - c * width] = 1
        other = dense if right is None else dense[len(left):]
        out += np.rint(dense[:len(left)] @ other.T).astype(np.int64)
    return out


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Spanning forest of ``pairs`` over n items by union-find."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["root", "i", "j"]):
            nodes = group.column("node").to_numpy()
            sets = [np.frombuffer(x, dtype=U64) for x in group.column("members").to_pylist()]
            block = group.column("block").to_numpy()
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(one) or not len(two) or len(nodes) < 2:
                continue
            same = i == j
            left, right = [sets[x] for x in one], None if same else [sets[x] for x in two]
            both = intersections(left, right)
            size_l = np.array([len(s) for s in left])
            size_r = size_l if same else np.array([len(s) for s in right])
            hit = 100 * both >= percent * (size_l[:, None] + size_r[None, :] - both)
            if same:
                hit = np.triu(hit, 1)
            pairs = np.argwhere(hit)
            pairs = np.stack([one[pairs[:, 0]], two[pairs[:, 1]]], axis=1)
            edges = forest(pairs, len(nodes))
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[e[:, 0]]), pa.array(nodes[e[:, 1]])], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: its set size and its component of near copies.

    Documents link when 100 * intersection >= ``percent`` * union of their shingle sets.
    Returns doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id
    (smallest doc_id reachable over links) and kept (doc_id = component_id).

    * Null or blank text, and texts without words: an empty set, linked with nothing and kept.
    * Fewer than ``words`` words: the whole sequence is the one shingle.
    * Null doc_id: no one can be tied to it, so class_id and component_id are null and it is kept.
    * Rows that repeat a doc_id are parts of one document: each gets a row of its own, and
      whatever one of them links with, all do.
    * Extra columns are not read; an empty table gives an empty result.
    """
    rows, bands = BANDS[percent]
    docs = docs.select("doc_id", "text")
    # Written, because the rest of the job reads them four times.
    sig = written(arrow_map(docs, _signatures(rows, bands, words),
                            "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "signatures")
    named = sig.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("class_id"))
    member = written(named.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"])
                     .select("doc_id", "n_shingles", "class_id"), "classes")
    # A doc_id with several texts ties its classes together.
    split = member.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a != b")
    split = member.select("doc_id", F.col("class_id").alias("b")).join(split.select("doc_id", "a"), "doc_id").select("a", "b")

    heads = member.where("doc_id = class_id").select("doc_id", "n_shingles").distinct()
    buckets = (named.select("doc_id", "n_shingles", "bands").join(heads, ["doc_id", "n_shingles"], "left_semi")
               .select("doc_id", F.explode("bands").alias("band")))
    first = buckets.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high")
    near = buckets.join(first.select("band", "low"), "band").where("doc_id != low")
    groups = written(connected_components(near.select(F.col("doc_id").alias("a"), F.col("low").alias("b")),
                                          "candidates"), "groups")
    blocks = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = (groups.join(blocks, "root")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    sets = arrow_map(docs.join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"),
                     _sets(words), "node long, members binary")
    paired = (placed.join(sets, "node")
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      "block", "node", "members"))
    links = arrow_map(paired.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"),
                      _links(percent), "a long, b long")
    parts = connected_components(links.union(split), "links")
    labels = (member.select("doc_id", "class_id").distinct()
              .join(parts.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
              .groupBy("doc_id").agg(F.min("class_id").alias("class_id"),
                                     F.min(F.coalesce("root", "class_id")).alias("component_id")))
    out = sig.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def dedup_documents(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies (the smallest doc_id).

    Of rows that repeat a doc_id one stays. All columns, also extra ones, are passed on.
    """
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti")
    again = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"),
                    "repeated")
    once = rest.join(F.broadcast(again) if again.count() <= 10_000 else again, "doc_id", "left_anti")
    return once.unionByName(rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents at a similarity of 0.85, as its contract states."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
