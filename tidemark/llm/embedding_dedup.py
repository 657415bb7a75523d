"""Near-duplicate vectors by cross-polytope hashing (operator 7).

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is
the axis it lies closest to, with its sign. ``hashes`` such hashes make a bucket of one of several
tables; a vector lives in one bucket of a table and visits those with the next best axes. Tables
are as many as ``MEET`` asks for at the threshold, and ``hashes`` as few as the vectors that share
a bucket allow (``work_plan``). Equal vectors are one class, known by its fingerprint pair. Those
that live in a bucket are compared with all that live there or visit it, exactly, in double
precision and in blocks, so no task holds a whole bucket and no list of pairs is made: a block
returns link counts and a spanning forest. A pair counts in the first bucket where it meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.llm._common import U64, _BASE, arrow_map, mix, sorted_groups, table, written
from tidemark.llm.components import connected_components
from tidemark.llm.minhash_dedup import forest

#: Least tables, and least probes where there are as many.
TABLES = 24
PROBES = 21
#: Share of isolated pairs at the threshold that meet in some table.
RECALL = 0.99
#: Expected unrelated vectors a vector meets, were the buckets even; real ones lean together.
STRAY = 5e-4
#: Share of pairs at the threshold that meet, where those who meet are compared at once.
MEET = 0.999
#: Making and moving a key of a vector takes about the time of so many comparisons of two vectors.
KEY_COST = 300
BLOCK = 512
#: Numbers in a temporary array of a task.
PIECE = 1 << 20
COSINE = 0.9


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; the width is a power of two."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    for _ in range(3):
        x = x * (rng.integers(0, 2, d) * 2.0 - 1)
        half = 1
        while half < d:
            y = x.reshape(n, d // (2 * half), 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            half *= 2
        x = x / math.sqrt(d)
    return x


def probe_plan(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` choices of ranks (0 is the best axis) with the least sums, best first."""
    plans = [tuple([0] * hashes)]
    for i in range(hashes):
        plans.append(tuple(1 if k == i else 0 for k in range(hashes)))
    for i in range(hashes):
        plans.append(tuple(2 if k == i else 0 for k in range(hashes)))
        for j in range(i):
            plans.append(tuple(1 if k in (i, j) else 0 for k in range(hashes)))
    return sorted(plans, key=lambda p: (sum(p), max(p), p))[:probes]


def bucket_keys(x: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Keys (rows x tables x probes) of unit vectors; the first probe is the vector's own bucket."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    if width > d:
        x = np.concatenate([x, np.zeros((n, width - d))], axis=1)
    plans = probe_plan(hashes, probes)
    out = np.zeros((n, tables, len(plans)), U64)
    for t in range(tables):
        codes = np.zeros((n, hashes, 3), U64)
        for k in range(hashes):
            y = rotate(x, 1000 * t + k)
            size = np.abs(y)
            top = np.argpartition(-size, 2, axis=1)[:, :3] if width > 2 else np.tile([0, 1, 1], (n, 1))
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, axis=1), axis=1, kind="stable"), axis=1)
            sign = np.take_along_axis(y, top, axis=1) < 0
            codes[:, k] = top * 2 + sign
        for p, plan in enumerate(plans):
            key = np.full(n, (t + 1) * 1_000_003 + d, U64)
            for k, rank in enumerate(plan):
                key = mix(key * _BASE + codes[:, k, rank])
            out[:, t, p] = key
    return out


def near_probes(hashes: int) -> int:
    """Probes for ``hashes`` hashes: all that change one axis, or two by one rank."""
    return 1 + 2 * hashes + hashes * (hashes - 1) // 2


def bucket_probes(hashes: int) -> int:
    """``near_probes``, or ``PROBES`` where there are more."""
    return max(PROBES, near_probes(hashes))


def bucket_tables(hashes: int, width: int, cosine: float = COSINE, probes: int | None = None,
                  recall: float = RECALL, least: int = TABLES) -> int:
    """Tables in which pairs at ``cosine`` meet with ``recall``, from the share that meets in one table.

    The share is measured on random pairs of vectors of ``width`` components.
    """
    if width < 2 or not -1 < cosine < 1:
        return TABLES
    pairs = min(256, max(128, 16384 // width))
    x, z = np.random.default_rng(7).normal(size=(2, pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z, axis=1, keepdims=True)
    probes = probes or bucket_probes(hashes)
    a, b = bucket_keys(x, hashes, TABLES, probes), bucket_keys(y, hashes, TABLES, probes)
    met = (a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)
    share = max(float(met.mean()), 1 / met.size)
    return max(least, math.ceil(math.log(1 - recall) / math.log(1 - min(share, 0.999))))


def bucket_plan(vectors: int, width: int, cosine: float = COSINE, tables: int | None = None,
                probes: int | None = None) -> tuple[int, int, int]:
    """(hashes, tables, probes) with fewer than ``STRAY`` unrelated vectors met and ``RECALL`` at the threshold."""
    axes = 2 * (1 << max(1, (max(width, 1) - 1).bit_length()))
    hashes = 1
    while True:
        most = STRAY * axes**hashes / max(2, vectors)
        wanted = probes or bucket_probes(hashes)
        if (tables or TABLES) * wanted <= most:
            made = tables or bucket_tables(hashes, width, cosine, wanted)
            if made * wanted <= most:
                return hashes, made, wanted
        hashes += 1


def work_plan(load: Callable[[int], float], vectors: int, width: int, cosine: float = COSINE, tables: int | None = None,
              probes: int | None = None) -> tuple[int, int, int]:
    """(hashes, tables, probes) of least work, given ``load(hashes)``, the mean number living in a vector's bucket.

    More hashes make smaller buckets but more keys. As ``load`` is measured, vectors that lean
    together get more hashes; ``bucket_plan`` bounds them, what then still meets is alike.
    """
    most = bucket_plan(vectors, width, cosine, tables, probes)[0]
    best: tuple[float, int, int, int] | None = None
    for hashes in range(1, most + 1):
        wanted = probes or near_probes(hashes)
        made = tables or bucket_tables(hashes, width, cosine, wanted, MEET, 1)
        if best and made * wanted * KEY_COST >= best[0]:
            break
        cost = made * wanted * (KEY_COST + load(hashes))
        if not best or cost < best[0]:
            best = cost, hashes, made, wanted
    return best[1:]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, raw vectors in double precision) of each width; unusable rows are left out."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        x = values[starts[rows][:, None] + np.arange(width)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        one, two, ok = np.zeros(n, U64), np.zeros(n, U64), np.zeros(n, bool)
        for rows, x in _vectors(batch):
            bits = (x + 0.0).view(U64)
            for out, seed in ((one, 1), (two, 2)):
                h = np.full(len(rows), seed * 7919 + x.shape[1], U64)
                for k in range(x.shape[1]):
                    h = mix(h * _BASE + bits[:, k])
                out[rows] = h
            ok[rows] = True
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(one.view(np.int64), mask=~ok), pa.array(two.view(np.int64), mask=~ok)],
            names=["vec_id", "embedding", "f1", "f2"])


def _pieces(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, row numbers, unit vectors), few enough that ``each`` numbers for each of them stay small."""
    for batch in batches:
        for rows, x in _vectors(batch):
            some = max(1, PIECE // max(each, x.shape[1]))
            for a in range(0, len(rows), some):
                yield batch, rows[a:a + some], _unit(x[a:a + some])


def _homes(hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in _pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(x, hashes, 1, 1).ravel().view(np.int64))], names=["key"])
    return run


def _keys(hashes: int, tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, x in _pieces(batches, tables * probes):
            keys = bucket_keys(x, hashes, tables, probes).reshape(len(x), -1).view(np.int64)
            ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                                             names=[*kept.schema.names, "keys"])
    return run


def _first(keys: np.ndarray, one: np.ndarray, two: np.ndarray, at: int, key: int) -> np.ndarray:
    """Whether a pair (``one`` lives in bucket ``key`` of table ``at``, ``two`` is there) met in no bucket before.

    ``keys`` (rows x tables x probes) has a row's own bucket first. Where both visit each other in
    the table, the bucket of the smaller key comes first.
    """
    new = (keys[two, at, 0] >= key) | (keys[one, at] != keys[two, at, :1]).all(axis=1)
    for t in range(at):
        left = np.flatnonzero(new)
        a, b = keys[one[left], t], keys[two[left], t]
        new[left] = (a != b[:, :1]).all(axis=1) & (b != a[:, :1]).all(axis=1)
    return new


def _links(cosine: float, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "i", "j"]):
            group = group.combine_chunks()
            key, at = group.column("key")[0].as_py(), group.column("at")[0].as_py() // probes
            nodes, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            lives, first, second = (group.column(c).to_numpy() for c in ("home", "first", "second"))
            if not first.any() or not second.any():
                continue
            keys = group.column("keys").chunk(0).flatten().to_numpy().reshape(len(nodes), -1, probes)
            edges, counts = [], np.zeros(len(nodes), np.int64)
            for rows, x in _vectors(group.select(["embedding"]).to_batches()[0]):
                x = _unit(x)
                one, two = np.flatnonzero(first[rows]), np.flatnonzero(second[rows])
                a, b = np.nonzero(x[one] @ x[two].T >= cosine)
                a, b = rows[one[a]], rows[two[b]]
                # Two that live here meet in both orders.
                once = ~lives[b] | (nodes[a] < nodes[b])
                a, b = a[once], b[once]
                new = _first(keys, a, b, at, key)
                a, b = a[new], b[new]
                np.add.at(counts, a, copies[b])
                np.add.at(counts, b, copies[a])
                edges += forest(np.stack([a, b], axis=1), len(nodes))
            linked = np.flatnonzero(counts)
            if len(linked):
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([nodes[e[:, 0]], nodes[linked]])),
                     pa.array(np.concatenate([nodes[e[:, 1]], np.zeros(len(linked), np.int64)]),
                              mask=np.arange(len(e) + len(linked)) >= len(e)),
                     pa.array(np.concatenate([np.zeros(len(e), np.int64), counts[linked]]))], names=["a", "b", "n"])
    return run


def _cells(spots: DataFrame) -> DataFrame:
    """Rows (key, at, home, node, i, j, first, second) of blocks ``i`` of those that live in a bucket by ``j`` of all there.

    ``spots(node, key, at, home)`` are the buckets of the vectors. ``first`` and ``second`` say
    whether a row is in block i or j of its cell; buckets where none can meet are left out.
    """
    sizes = (spots.groupBy("key").agg(F.count_if("home").alias("living"), F.count(F.lit(1)).alias("all"))
             .where("living > 0 and `all` > 1")
             .select("key", F.ceil(F.col("living") / BLOCK).cast("int").alias("rows"),
                     F.ceil(F.col("all") / BLOCK).cast("int").alias("columns")))
    return (spots.join(sizes, "key")
            .withColumn("row", F.expr("cast(pmod(xxhash64(node), rows) as int)"))
            .withColumn("column", F.expr("cast(pmod(xxhash64(node), columns) as int)"))
            .select("key", "at", "home", "node", F.expr("""inline(concat(
                if(home, transform(sequence(0, columns - 1), j -> struct(row as i, j as j, true as first, j = column as second)),
                         array()),
                transform(filter(sequence(0, rows - 1), i -> not home or i != row),
                          i -> struct(i as i, column as j, false as first, true as second))))""")))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int | None = None,
                 hashes: int | None = None) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, ...)``: n_links, component_id and kept.

    ``hashes`` grows with the logarithm of the number of vectors that share a bucket, so that
    comparing them takes no more than the keys of smaller buckets would; ``tables`` and ``probes``
    grow with it, so that recall at ``cosine`` holds for any table size.

    * Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    * Vectors of different width do not link. Equal vectors are one class and link with each other.
    * A null vec_id cannot be tied: no links, null component, kept. Rows that repeat a vec_id
      count as vectors of their own, each with its own links, but share a component.
    * Extra columns are not read; an empty table gives an empty result.
    """
    vectors = vectors.select("vec_id", "embedding")
    fields = T.StructType([T.StructField("vec_id", T.LongType()), vectors.schema["embedding"],
                           T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType())])
    vectors = vectors.withColumn("vec_id", F.col("vec_id").cast("long"))
    marked = arrow_map(vectors, _prints, fields)
    prints = written(marked.select("vec_id", "f1", "f2"), "prints")
    heads = written(marked.where("vec_id is not null and f1 is not null").groupBy("f1", "f2")
                    .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding"))
                    .withColumn("node", F.monotonically_increasing_id()), "heads")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    count = heads.count()

    def load(k: int) -> float:
        living = arrow_map(heads.select("embedding"), _homes(k), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return (living.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) / max(1, count)

    if hashes is None:
        hashes, tables, probes = work_plan(load, count, width, cosine, tables, probes)
    else:
        probes = probes or bucket_probes(hashes)
        tables = tables or bucket_tables(hashes, width, cosine, probes)
    probes = len(probe_plan(hashes, probes))
    some = heads.select("node", "copies", "embedding")
    keyed = written(arrow_map(some, _keys(hashes, tables, probes), T.StructType(
        [*some.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])), "keys")
    spots = (keyed.select("node", "keys", F.posexplode("keys").alias("at", "key"))
             .where(F.array_position("keys", F.col("key")) == F.col("at") + 1)
             .select("node", "key", "at", (F.col("at") % probes == 0).alias("home")))
    placed = _cells(spots).join(keyed, "node")
    found = written(arrow_map(placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), _links(cosine, probes),
                              "a long, b long, n long"), "links")
    # Links between classes, and the rows of a repeated vec_id, meet at the smallest vec_id of their classes.
    low = heads.select(F.col("node").alias("a"), "low")
    linked = (found.where("b is not null").select("a", "b").join(low, "a")
              .join(low.toDF("b", "other"), "b").select(F.col("low").alias("a"), F.col("other").alias("b")))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = heads.join(counts, "node", "left").select(
        "f1", "f2", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = written(prints.join(labels, ["f1", "f2"], "left").select("vec_id", "n_links", "low"), "rows")
    parts = connected_components(linked.union(rows.select(F.col("vec_id").alias("a"), F.col("low").alias("b"))), "parts")
    component = F.coalesce("root", "vec_id")
    return rows.join(parts.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all embeddings, as its contract states."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
