"""Retrieval index and search operators (C-08, P-14..P-18, J-06, J-08, E-01, R-01..R-04, S-10, S-11, A-09).

kNN is exact and both sides stay distributed: queries are dealt into blocks, the index into
parts, and each (block, part) group is scored as one NumPy product and keeps only its per-query
top candidates, so ``parts x queries x k`` rows are shuffled on, never the query x chunk product.
A final rank in Spark applies the exact tie rule (rounded score desc, then chunk id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import CHARS_PER_TOKEN, chunk_array, chunk_count, chunk_id, file_mtime_key, snippet

# Over-fetch factor for suffix post-filtering and embedding batch size.
POSTFILTER_FACTOR = 3
EMBED_BATCH = 32
#: Queries scored together; a group of the kNN join holds one such block and one part of the index.
QUERY_BLOCK = 1024
SCORE_DIGITS = 6

_WS_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_WS_CHAR = r"(?U)^[\s\x1c-\x1f]$"


# ------------------------------------------------------------------ text and chunks

def read_text(files: DataFrame, content: str = "content") -> DataFrame:
    """C-08: decode UTF-8 replacing bad bytes, strip, drop empty texts."""
    raw = F.make_valid_utf8(F.col(content).cast("string"))
    # Only texts that begin or end with white space pay for the regex.
    edge = raw.substr(F.lit(1), F.lit(1)).rlike(_WS_CHAR) | raw.substr(F.lit(-1), F.lit(1)).rlike(_WS_CHAR)
    txt = F.when(edge, F.regexp_replace(raw, _WS_EDGES, "")).otherwise(raw)
    return files.withColumn("text", txt).drop(content).where(F.col("text") != "")


def chunk_text(df: DataFrame, text_col: str = "text", chunk_tokens: int = 500, overlap_tokens: int = 50) -> DataFrame:
    """P-14: one row per overlapping window: ``chunk`` (0-based), ``total_chunks``, ``text``."""
    size = chunk_tokens * CHARS_PER_TOKEN
    step = size - overlap_tokens * CHARS_PER_TOKEN
    arr = chunk_array(F.col(text_col), chunk_tokens, overlap_tokens)
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.coalesce(chunk_count(F.col(text_col), size, step), F.lit(0)).alias("total_chunks"),
                     F.posexplode(arr).alias("chunk", text_col)).withColumn("chunk", F.col("chunk").cast("bigint"))


def corpus_labels(files: DataFrame, roots: DataFrame | list[str], path_col: str = "path", root_col: str = "root") -> DataFrame:
    """P-16: repo name and relative path per file; the longest root that is a whole-path-part
    prefix wins (``infra-rg`` files are not labelled ``infra``, trap T7); ``unknown`` without one.

    Each file's ancestor folders are matched against the (bounded) root list inside the row;
    no join and no shuffle of the file rows.
    """
    parts = F.split(F.col(path_col), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    # The roots are a configured list (bounded): one sorted array, attached to every row as a
    # scalar subquery, so the lookup is row-local - no shuffle of the file rows. A Python list is
    # a literal and needs no job.
    if isinstance(roots, list):
        root_arr = F.array(*[F.lit(r) for r in sorted({r.rstrip("/") for r in roots})]).cast("array<string>")
    else:
        root_arr = roots.select(F.sort_array(F.collect_set(F.regexp_replace(F.col(root_col), "/+$", ""))).alias("r")).scalar()
    out = files.withColumn("_roots", root_arr).withColumn("_anc", ancestors)
    hit = F.filter(F.col("_roots"), lambda r: F.array_contains(F.col("_anc"), r))
    best = F.array_max(F.transform(hit, lambda r: F.struct(F.length(r).alias("n"), r.alias("root"))))["root"]
    out = out.withColumn("_root", best).drop("_roots", "_anc")
    repo = F.coalesce(F.substring_index("_root", "/", -1), F.lit("unknown"))
    rel = F.when(F.col("_root").isNotNull(),
                 F.concat(repo, F.col(path_col).substr(F.length("_root") + 1, F.lit(1 << 30))))
    return out.withColumn("repo", repo).withColumn("rel_path", F.coalesce(rel, F.col(path_col))).drop("_root")


def chunk_rows(texts: DataFrame, path_col: str = "path", mtime_col: str = "mtime") -> DataFrame:
    """P-14 + P-15: chunk rows with ``chunk_id = path::j::mtime`` and ``file_mtime_key``."""
    c = chunk_text(texts)
    return (c.withColumn("chunk_id", chunk_id(path_col, "chunk", mtime_col))
            .withColumn("file_mtime_key", file_mtime_key(path_col, mtime_col)))


def unchanged_files(files: DataFrame, index: DataFrame, path_col: str = "path", mtime_col: str = "mtime",
                    changed: bool = True) -> DataFrame:
    """J-06: files whose ``path:mtime`` key is not yet indexed (``changed=True``: the work), or
    the ones already indexed (``changed=False``: the skipped). Runs before any content read."""
    keys = index.select("file_mtime_key").distinct()
    f = files.withColumn("file_mtime_key", file_mtime_key(path_col, mtime_col))
    return f.join(keys, "file_mtime_key", "left_anti" if changed else "left_semi")


# ------------------------------------------------------------------ embeddings (E-01)

def hash_embed(df: DataFrame, text_col: str = "text", dim: int = 256, out: str = "embedding") -> DataFrame:
    """Built-in deterministic embedding: hashed term counts of lower-cased word tokens,
    L2-normalised (``HashingTF`` + ``Normalizer``, both JVM side)."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tok = df.withColumn("_tok", F.filter(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim).transform(tok)
    nv = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0).transform(tf)
    return nv.withColumn(out, vector_to_array("_nv", "float32")).drop("_tok", "_tf", "_nv")


def embed_with(df: DataFrame, fn, text_col: str = "text", batch: int = EMBED_BATCH, out: str = "embedding") -> DataFrame:
    """E-01 with a user function ``fn(list[str]) -> list[vector]`` called on batches of ``batch``
    texts inside the tasks. A failing batch yields NULL vectors and its error text in
    ``embed_error`` (filter on it for the error relation) instead of a log line."""
    schema = df.schema.simpleString()[7:-1] + f", {out} array<float>, embed_error string"

    def run(batches):
        for pdf in batches:
            vecs, errs = [None] * len(pdf), [None] * len(pdf)
            texts = pdf[text_col].tolist()
            for s in range(0, len(texts), batch):
                try:
                    got = fn(texts[s:s + batch])
                    for i, v in enumerate(got):
                        vecs[s + i] = [float(x) for x in v]
                except Exception as exc:  # noqa: BLE001 - the batch is reported, not fatal
                    for i in range(s, min(s + batch, len(texts))):
                        errs[i] = f"{type(exc).__name__}: {exc}"
            yield pdf.assign(**{out: vecs, "embed_error": errs})

    return df.mapInPandas(run, schema)


# ------------------------------------------------------------------ kNN (R-01, R-02, J-08)

def _matrix(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.linalg.norm(m, axis=1)[:, None]


def tile_scores(rows: np.ndarray, queries: np.ndarray, k: int | None, min_score: float | None,
                tile: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, cosine) of unit ``rows`` and ``queries``, a tile of queries at a
    time: all that reach ``min_score``, or all within rounding reach of each query's ``k``-th best
    (ties are settled later). Rows without a direction are NaN and match nothing."""
    out_q, out_r, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for at in range(0, len(queries) if len(rows) else 0, tile):
        scores = queries[at:at + tile] @ rows.T
        scores[np.isnan(scores)] = -np.inf
        least = np.full(len(scores), -2.0 if min_score is None else min_score)
        if k is not None and scores.shape[1] > k:
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k] - 10.0 ** -SCORE_DIGITS)
        q, r = np.nonzero(scores >= least[:, None])
        out_q.append(q + at)
        out_r.append(r)
        out_s.append(scores[q, r])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def _picked(rows: pd.DataFrame, query_ids, hits, key: str, keep: list[str]) -> pd.DataFrame:
    q, r, s = hits
    res = {"_q": pd.Series(query_ids, dtype=object).iloc[q], key: rows[key].iloc[r], "score": s} | {c: rows[c].iloc[r] for c in keep}
    return pd.DataFrame({c: pd.Series(v.tolist(), dtype="float64" if c == "score" else object) for c, v in res.items()})


def _scored_in_place(index: DataFrame, ids: list, vectors: np.ndarray, schema: str, key: str, vec: str, keep: list[str],
                     k: int | None, min_score: float | None) -> DataFrame:
    """Candidates of a few queries, held by every task: the index stays where it lies. With ``k``
    a task keeps its best so far and lets go of the rest batch by batch."""
    shared = index.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches):
        query_ids, q = shared.value
        best = None
        for pdf in batches:
            found = _picked(pdf, query_ids, tile_scores(_matrix(pdf[vec]), q, k, min_score), key, keep) if len(pdf) else None
            if found is None:
                continue
            if k is None:
                yield found
                continue
            best = found if best is None else pd.concat([best, found], ignore_index=True)
            place = best["score"].round(SCORE_DIGITS).groupby(best["_q"], sort=False).rank(ascending=False, method="min")
            best = best[place <= k]
        if best is not None and len(best):
            yield best

    return index.select(key, vec, *keep).where(F.col(vec).isNotNull()).mapInPandas(run, schema)


def _scored(queries: DataFrame, index: DataFrame, key: str, vec: str, query_key: str, query_vec: str, keep: list[str],
            k: int | None, min_score: float | None) -> DataFrame:
    """(query_key, key, score, keep...): the candidates of every query.

    Up to ``QUERY_BLOCK`` queries (counted) go to all tasks and the index is scanned in place;
    more are dealt into blocks, and each (query block, index part) is one group. NULL vectors
    take no part; zero vectors have no cosine and match nothing.
    """
    spark = index.sparkSession
    types = dict(index.dtypes)
    schema = ", ".join([f"_q {dict(queries.dtypes)[query_key]}", f"{key} {types[key]}", "score double",
                        *[f"{c} {types[c]}" for c in keep]])
    asked = queries.select(F.col(query_key).alias("_q"), F.col(query_vec).alias("_qv")).where("_qv is not null")
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if len(few) <= QUERY_BLOCK:
        if not few:
            return index.sparkSession.createDataFrame([], schema).withColumnRenamed("_q", query_key)
        out = _scored_in_place(index, [r["_q"] for r in few], _matrix([r["_qv"] for r in few]), schema, key, vec, keep, k, min_score)
        return out.withColumnRenamed("_q", query_key)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    q = (asked.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(blocks)))
         .withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))))
    i = (index.select(key, vec, *keep).where(F.col(vec).isNotNull())
         .withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
         .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))))
    run = group_scorer(key, vec, keep, k, min_score)
    return (i.groupBy("_block", "_part").cogroup(q.groupBy("_block", "_part")).applyInPandas(run, schema)
            .withColumnRenamed("_q", query_key))


def group_scorer(key: str, vec: str, keep: list[str], k: int | None, min_score: float | None):
    """Scores the rows of one group against its queries (``_q``, ``_qv``)."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hits = tile_scores(_matrix(left[vec]), _matrix(right["_qv"]), k, min_score) if len(left) and len(right) else \
            (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return _picked(left, right["_q"].tolist(), hits, key, keep)
    return run


def knn(queries: DataFrame, index: DataFrame, k: int = 5, *, where: Column | None = None, key: str = "chunk_id",
        vec: str = "embedding", query_key: str = "query_id", query_vec: str = "embedding",
        keep: list[str] | None = None) -> DataFrame:
    """R-01: top-``k`` index rows per query by cosine similarity, after an optional pre-filter
    (F-07, pushed to the scan). Rows: ``query_id, rank, <key>, score`` (+ ``keep`` columns);
    score rounded to 6 digits, ties broken by the key. Query ids may be of any type."""
    keep = keep or []
    idx = index.where(where) if where is not None else index
    cand = _scored(queries, idx, key, vec, query_key, query_vec, keep, k, None)
    cand = cand.withColumn("score_raw", F.col("score")).withColumn("score", F.round("score", SCORE_DIGITS))
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), F.col(key).asc())
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(query_key, "rank", key, "score", "score_raw", *keep))


def knn_postfilter(queries: DataFrame, index: DataFrame, k: int = 5, *, ext: str, path_col: str = "rel_path",
                   key: str = "chunk_id", **kw) -> DataFrame:
    """R-02 (literal, trap T9): fetch ``3k``, keep rows whose path ends in ``.ext``, at most
    ``k`` of them - possibly fewer."""
    keep = list(dict.fromkeys((kw.pop("keep", None) or []) + [path_col]))
    wide = knn(queries, index, POSTFILTER_FACTOR * k, key=key, keep=keep, **kw)
    qk = kw.get("query_key", "query_id")
    hit = wide.where(F.col(path_col).endswith(f".{ext}"))
    w = Window.partitionBy(qk).orderBy(F.col("rank").asc())
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similarity_join(queries: DataFrame, index: DataFrame, min_score: float, *, key: str = "chunk_id",
                    vec: str = "embedding", query_key: str = "query_id", query_vec: str = "embedding") -> DataFrame:
    """J-08: every (query, row) pair whose cosine similarity reaches ``min_score``."""
    out = _scored(queries, index, key, vec, query_key, query_vec, [], None, min_score)
    return out.withColumn("score", F.round("score", SCORE_DIGITS))


def knn_approx(queries: DataFrame, index: DataFrame, k: int = 5, *, key: str = "chunk_id", vec: str = "embedding",
               query_key: str = "query_id", query_vec: str = "embedding", nprobe: int = 8, complete: bool = True) -> DataFrame:
    """R-03 for one call: build inverted lists in the scratch folder and probe them. Keep the lists
    of an index that is asked more than once (``inverted_lists``)."""
    from tidemark.operators.inverted_lists import build_lists, knn_lists
    from tidemark.session import scratch_path

    at = scratch_path(index.sparkSession, "inverted-lists")
    build_lists(index.select(key, vec), at, key=key, vec=vec)
    return knn_lists(queries, at, k, nprobe=nprobe, complete=complete, key=key, vec=vec, query_key=query_key, query_vec=query_vec)


def result_listing(hits: DataFrame, *, text_col: str = "text", path_col: str = "rel_path") -> DataFrame:
    """R-04: ranked result rows - position, path, ``chunk n/total``, score to 3 digits
    (P-18) and the snippet (P-17)."""
    return hits.select(
        "query_id", "rank", F.col(path_col).alias("rel_path"),
        F.concat(F.lit("chunk "), (F.col("chunk") + 1).cast("string"), F.lit("/"),
                 F.col("total_chunks").cast("string")).alias("chunk_label"),
        # Formatted from the unrounded score, so no decimal tie can arise from the 6-digit rounding.
        F.format_string("%.3f", F.col("score_raw" if "score_raw" in hits.columns else "score")).alias("score_text"),
        snippet(text_col).alias("snippet"))


# ------------------------------------------------------------------ index writes (S-10, S-11) and stats (A-09)

def upsert_index(index: DataFrame | None, new_chunks: DataFrame, *, prune: bool = False,
                 corpus_keys: DataFrame | None = None) -> DataFrame:
    """S-10: the next index - old rows whose id is not re-written, plus the new rows.

    ``prune=False`` is literal (trap T8: chunks of changed or deleted files stay searchable);
    ``prune=True`` also drops old rows of re-indexed files and, given ``corpus_keys`` (the
    current ``file`` column of the corpus), rows of files no longer present.
    """
    if index is None:
        return new_chunks
    old = index.join(new_chunks.select("chunk_id"), "chunk_id", "left_anti")
    if prune:
        old = old.join(new_chunks.select("file").distinct(), "file", "left_anti")
        if corpus_keys is not None:
            old = old.join(corpus_keys.select("file").distinct(), "file", "left_semi")
    return old.unionByName(new_chunks.select(*old.columns))


def corpus_stats(index: DataFrame) -> DataFrame:
    """A-09: chunks and files per repo."""
    return index.groupBy("repo").agg(F.countDistinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_chunks"))
