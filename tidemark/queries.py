"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each binds an operator to the fixture views over the driver tables (FIXTURES.md part B);
the matching DuckDB string lives in ``tidemark.oracle_sql`` under the same key. Computed
columns carry the same aliases on both sides; doubles are rounded to 6 digits.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.checksums import meta_checksum, meta_file_id, normalize_checksum
from tidemark.functions.mime import is_video_like
from tidemark.functions.paths import bucket_key, expected_key, key_basename, object_key, sanitize_file_name
from tidemark.functions.probe import parse_probe
from tidemark.functions.sizes import chunk_ranges, effective_size, sample_offsets
from tidemark.operators import boards, catalog as cat
from tidemark.operators.integrity import content_hash, frame_verdict, pixel_stddev
from tidemark.operators.joins import (
    FILE_KEY, fetch_metadata, join_catalog_inventory, join_listing_catalog, not_in_catalog, point_lookup,
    stat_objects, with_config,
)
from tidemark.plans.audit import audit_sources, issue_set
from tidemark.plans.integrity import diagnose_bytes, diagnose_files, frame_samples, quarantine, validate_media
from tidemark.plans.sync import discover, plan_sync, verify_transfer
from tidemark.sources.fixtures import CHUNK_BYTES, STALE_SECONDS, fixtures
from tidemark.sources.corpus import MAX_BYTES
from tidemark.sources.tables import table
from tidemark.functions.text import file_mtime_key, snippet
from tidemark.operators.retrieval import (
    chunk_text, corpus_labels, corpus_stats, hash_embed, knn, knn_postfilter, read_text, similarity_join,
    unchanged_files,
)
from tidemark.plans.index import INDEX_COLUMNS, index_texts, search

Query = Callable[[SparkSession, str], DataFrame]
CATALOG_COLUMNS = cat.CATALOG_COLUMNS


def _as_of(catalog: DataFrame):
    # The fixture clock: newest catalog change, as a scalar subquery (no driver round trip).
    return catalog.select(F.max("updated_at")).scalar()


def _sync_inputs(spark, sf):
    return fixtures(spark, sf, "fx_listing", "fx_catalog", "fx_inventory")


def _plan(spark, sf, **kw):
    listing, catalog, inventory = _sync_inputs(spark, sf)
    return plan_sync(listing, catalog, inventory, as_of=_as_of(catalog), stale_seconds=STALE_SECONDS, **kw), catalog, inventory


# ---------------------------------------------------------------- sync planning (K-01)

def q_plan_sync(spark, sf):
    plan, _, _ = _plan(spark, sf)
    return plan.select("source_name", "file_id", "file_name", "checksum", "size", "object_key",
                       "status", "action", "reason")


def q_sync_predicates(spark, sf):
    plan, _, _ = _plan(spark, sf, with_flags=True)
    return plan.where(F.col("id").isNotNull()).select(
        *FILE_KEY, "is_fresh", "checksum_changed", "skip_from_catalog", "skip_from_store", "attempts_left")


def q_join_plan_inputs(spark, sf):
    plan, _, _ = _plan(spark, sf)
    return plan.select(*FILE_KEY, "id", "object_key", "object_size")


# ---------------------------------------------------------------- catalog updates (S-*)

def q_upsert_discovered(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    return cat.upsert_discovered(catalog, listing, as_of=_as_of(catalog)).select(*CATALOG_COLUMNS)


def q_discover(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    nxt, _ = discover(listing, catalog, as_of=_as_of(catalog))
    return nxt.select(*CATALOG_COLUMNS)


def q_discover_work(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    return discover(listing, catalog, as_of=_as_of(catalog))[1]


def q_requeue_changed(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    as_of = _as_of(catalog)
    upserted = cat.upsert_discovered(catalog, listing, as_of=as_of)
    return cat.requeue_changed(catalog, upserted, as_of=as_of).select(*CATALOG_COLUMNS)


def q_assign_ids(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    fresh = not_in_catalog(listing, catalog).select(*FILE_KEY)
    return cat.assign_ids(fresh, catalog.select(F.max("id")).scalar()).select(*FILE_KEY, "id")


def q_not_in_catalog(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    return not_in_catalog(listing, catalog).select(*FILE_KEY, "file_name")


def _verified(spark, sf):
    plan, catalog, inventory = _plan(spark, sf)
    outcomes = verify_transfer(plan.where(F.col("action") == "TRANSFER"), inventory)
    return outcomes, catalog


def q_verify_transfer(spark, sf):
    outcomes, _ = _verified(spark, sf)
    return outcomes.select(*FILE_KEY, "outcome", "checksum", "size", "object_key", "message")


def q_mark_uploaded(spark, sf):
    outcomes, catalog = _verified(spark, sf)
    return cat.apply_outcomes(catalog, outcomes.where(F.col("outcome") == "ok"), as_of=_as_of(catalog))


def q_mark_failed(spark, sf):
    outcomes, catalog = _verified(spark, sf)
    return cat.apply_outcomes(catalog, outcomes.where(F.col("outcome") == "failed"), as_of=_as_of(catalog))


def q_reconcile_from_store(spark, sf):
    plan, catalog, _ = _plan(spark, sf)
    return cat.reconcile_from_store(plan, catalog, as_of=_as_of(catalog))


def q_reset_stale(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    out, _obs = cat.reset_stale(catalog, as_of=_as_of(catalog), older_than=STALE_SECONDS)
    return out.select(*CATALOG_COLUMNS)


def _arrivals(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    old = catalog.select(*FILE_KEY, "file_name", F.col("checksum").alias("md5"), "size", F.lit(0).alias("seq"))
    new = listing.select(*FILE_KEY, "file_name", "md5", "size", F.lit(1).alias("seq"))
    return old.unionByName(new)


def q_last_wins(spark, sf):
    return cat.last_wins(_arrivals(spark, sf), FILE_KEY, ["seq"]).select(*FILE_KEY, "file_name", "md5", "size", "seq")


def q_key_violations(spark, sf):
    return cat.key_violations(_arrivals(spark, sf))


def q_count_files(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    return cat.count_files(catalog)


def q_filter_files(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    return cat.filter_files(catalog, source_name="src3", name_contains="CLIP_").select(*CATALOG_COLUMNS)


def q_files_page(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    page, _ = cat.files_page(catalog, status="UPLOADED", name_contains="clip", limit=50)
    return cat.listing_projection(page)


def q_files_page_cursor(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    _, cursor = cat.files_page(catalog, status="UPLOADED", name_contains="clip", limit=50)
    return cursor


def q_cursor_after(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    page, _ = cat.files_page(catalog, source_name="src7", cursor_updated_at="2024-01-20 12:00:00",
                             cursor_id=500, limit=10)
    return cat.listing_projection(page)


def q_claim_next(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    claimed, _ = cat.claim_next(catalog, as_of=_as_of(catalog), n=25)
    return claimed.select(*CATALOG_COLUMNS)


def q_claim_next_catalog(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    _, nxt = cat.claim_next(catalog, as_of=_as_of(catalog), n=25)
    return nxt.select(*CATALOG_COLUMNS)


def q_offset_page(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    order = [F.col("updated_at").desc(), F.col("id").desc()]
    return boards.page_with_total(catalog.select(*CATALOG_COLUMNS), order, page=2, size=50, status="UPLOADED")


def q_resolve_by_name(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    return cat.resolve_by_name(listing.select("source_name", "file_name"), catalog)


def q_listing_projection(spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    return cat.listing_projection(catalog, view="candidates")


# ---------------------------------------------------------------- expressions (P-*)

def _files(spark, sf):
    listing, catalog, inventory = _sync_inputs(spark, sf)
    return join_listing_catalog(listing, catalog), inventory


def q_file_expressions(spark, sf):
    j, _ = _files(spark, sf)
    built = object_key("source_name", "file_id", "file_name")
    return j.select(
        *FILE_KEY,
        normalize_checksum("c_checksum").alias("checksum_norm"),
        sanitize_file_name("file_name").alias("safe_name"),
        built.alias("built_key"),
        bucket_key(F.concat(F.lit("//"), built)).alias("bucket_key"),
        key_basename("c_object_key").alias("key_basename"),
        is_video_like("mime_type", "file_name").alias("video_like"),
        effective_size("size", "c_size").alias("effective_size"),
        expected_key("c_object_key", built).alias("expected_key"),
    )


def q_meta_checksum(spark, sf):
    _, _, inventory = _sync_inputs(spark, sf)
    return inventory.select("object_key", meta_checksum("metadata").alias("checksum"))


def q_join_listing_catalog(spark, sf):
    j, _ = _files(spark, sf)
    return j.select(*FILE_KEY, "file_name", F.col("c_id").alias("id"), F.col("c_status").alias("status"))


def q_join_catalog_inventory(spark, sf):
    _, catalog, inventory = _sync_inputs(spark, sf)
    j = join_catalog_inventory(catalog, inventory)
    return j.select("id", "object_key", F.col("o_size").alias("object_size"), F.col("o_checksum").alias("object_checksum"))


def q_config_join(spark, sf):
    listing, _, _ = _sync_inputs(spark, sf)
    config = listing.groupBy("source_name").agg(
        F.when(F.min("doc_id") % 2 == 0, F.concat(F.lit("video/"), F.col("source_name"))).alias("object_prefix"))
    j = with_config(listing, config)
    return j.select(*FILE_KEY, "object_prefix",
                    object_key("source_name", "file_id", "file_name", "object_prefix").alias("object_key"))


def q_sync_counts(spark, sf):
    listing, _, _ = _sync_inputs(spark, sf)
    return (listing.where(is_video_like("mime_type", "file_name")).groupBy("source_name")
            .agg(F.count(F.lit(1)).alias("discovered")))


# ---------------------------------------------------------------- audit (K-04)

def _audit(spark, sf, full=False):
    listing, catalog, inventory = _sync_inputs(spark, sf)
    return audit_sources(listing, catalog, inventory, full=full)


def _items(df):
    return df.withColumn("issues", F.array_join("issues", ","))


def q_audit_sources(spark, sf):
    return _items(_audit(spark, sf).items)


def q_audit_union(spark, sf):
    return _items(_audit(spark, sf, full=True).items)


def q_audit_summary(spark, sf):
    return _audit(spark, sf).summary


def q_audit_totals(spark, sf):
    return _audit(spark, sf).totals


def q_orphan_objects(spark, sf):
    items = _audit(spark, sf).items
    return _items(items.where(F.array_contains("issues", "orphaned_in_store")))


def q_issue_set(spark, sf):
    return issue_set(_audit(spark, sf).items)


# ---------------------------------------------------------------- integrity (K-05..K-07)

def _bytes(spark, sf):
    (b,) = fixtures(spark, sf, "fx_bytes")
    files = b.select("doc_id", F.concat(F.lit("bytes/"), F.col("doc_id").cast("string")).alias("object_key"),
                     F.length("source_bytes").cast("bigint").alias("source_size"), "source_md5", "meta_checksum")
    source = b.select("doc_id", F.col("source_bytes").alias("content"))
    store = b.where(F.col("stored_bytes").isNotNull()).select("doc_id", F.col("stored_bytes").alias("content"))
    return files, source, store


def q_diagnose_bytes(spark, sf):
    files, source, store = _bytes(spark, sf)
    report, _ = diagnose_bytes(files, source, store, key="doc_id", chunk=CHUNK_BYTES)
    return report


def q_diagnose_bytes_full(spark, sf):
    files, source, store = _bytes(spark, sf)
    report, _ = diagnose_bytes(files, source, store, key="doc_id", chunk=CHUNK_BYTES, mode="full")
    return report


def _byte_files(spark, sf):
    """The two copies of ``fx_bytes`` as objects inside files, with what listing and inventory say of them."""
    from tidemark.sources.materialize import write_packed
    files, source, store = _bytes(spark, sf)

    def packed(side, name):
        at = _scratch(spark, name)
        write_packed(side.withColumn("content", F.col("content").cast("binary")), f"{at}/objects", "doc_id").write.parquet(f"{at}/rows")
        return spark.read.parquet(f"{at}/rows")
    one, two = packed(source, "source-objects"), packed(store, "store-objects")
    sized = files.drop("source_size").join(one.select("doc_id", F.col("size").alias("source_size")), "doc_id", "left")
    return sized, one, two


def q_diagnose_files(spark, sf):
    report, _ = diagnose_files(*_byte_files(spark, sf), key="doc_id", chunk=CHUNK_BYTES)
    return report


def q_diagnose_files_full(spark, sf):
    report, _ = diagnose_files(*_byte_files(spark, sf), key="doc_id", mode="full")
    return report


def q_range_read(spark, sf):
    _, compared = diagnose_files(*_byte_files(spark, sf), key="doc_id", chunk=CHUNK_BYTES)
    return compared.select("doc_id", "name", "offset", "length", "source_sha256", "store_sha256", "match")


def q_hash_compare(spark, sf):
    files, source, store = _bytes(spark, sf)
    _, compared = diagnose_bytes(files, source, store, key="doc_id", chunk=CHUNK_BYTES)
    return compared


def q_all_ranges_match(spark, sf):
    from tidemark.operators.integrity import all_ranges_match
    return all_ranges_match(q_hash_compare(spark, sf), "doc_id")


def q_content_hash(spark, sf):
    (b,) = fixtures(spark, sf, "fx_bytes")
    return b.select("doc_id", content_hash("source_bytes").alias("source_sha256"),
                    content_hash("stored_bytes").alias("store_sha256"))


def q_chunk_ranges(spark, sf):
    (b,) = fixtures(spark, sf, "fx_bytes")
    r = b.select("doc_id", F.explode(chunk_ranges(F.length("source_bytes"), CHUNK_BYTES)).alias("r"))
    return r.select("doc_id", "r.name", "r.offset", "r.length")


def q_range_distinct(spark, sf):
    from tidemark.operators.setops import range_distinct
    (b,) = fixtures(spark, sf, "fx_bytes")
    return range_distinct(b.select("doc_id", F.length("source_bytes").cast("bigint").alias("size")), "doc_id",
                          CHUNK_BYTES)


def _frames(spark, sf):
    (fr,) = fixtures(spark, sf, "fx_frames")
    return fr.withColumnRenamed("file_no", "doc_id")


def q_pixel_stddev(spark, sf):
    fr = _frames(spark, sf)
    return fr.select("doc_id", "sample_no", F.round(pixel_stddev("pixels", "scale"), 6).alias("variance"))


def q_frame_verdict(spark, sf):
    v = frame_verdict(frame_samples(_frames(spark, sf), "doc_id"), "doc_id")
    return v.select("doc_id", F.col("failed.rel").alias("failed_rel"),
                    F.round("failed.variance", 6).alias("failed_variance"),
                    F.round("last_variance", 6).alias("last_variance"), "n_samples")


def _validated(spark, sf):
    (probe,) = fixtures(spark, sf, "fx_probe")
    return validate_media(probe.select("doc_id", "file_size"), probe.select("doc_id", "probe_json"),
                          _frames(spark, sf), key="doc_id")


def q_validate_media(spark, sf):
    return _validated(spark, sf).withColumn("variance", F.round("variance", 6))


def q_parse_probe(spark, sf):
    (probe,) = fixtures(spark, sf, "fx_probe")
    return probe.select("doc_id", parse_probe("probe_json").alias("p")).select("doc_id", "p.*")


def q_sample_offsets(spark, sf):
    (probe,) = fixtures(spark, sf, "fx_probe")
    s = probe.select("doc_id", F.explode(sample_offsets("file_size")).alias("s"))
    return s.select("doc_id", "s.rel", "s.offset", "s.min_variance")


def q_mark_corrupted(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    v = _validated(spark, sf).join(listing.select("doc_id", *FILE_KEY), "doc_id")
    return quarantine(catalog, v, as_of=_as_of(catalog))


# ---------------------------------------------------------------- retrieval (P-14..P-18, R-*, K-08, K-09)

def _doc_texts(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/docs/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    texts = docs.select("doc_id", path.alias("path"), F.col("n_chars").cast("string").alias("mtime"), "text")
    roots = docs.select(F.concat(F.lit("/corpus/"), F.col("source")).alias("root")).distinct()
    return texts, roots


def _stripped(spark, sf):
    texts, roots = _doc_texts(spark, sf)
    return read_text(texts.withColumn("content", F.col("text").cast("binary")).drop("text")), roots


def q_read_text(spark, sf):
    t, _ = _stripped(spark, sf)
    return t.select("doc_id", "text")


def q_chunk_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunk_text(docs).select("doc_id", "chunk", "total_chunks", "text")


def _built(spark, sf, embed=None):
    t, roots = _stripped(spark, sf)
    return index_texts(t.select("path", "mtime", "text"), roots, embed=embed)


def q_build_index(spark, sf):
    return _built(spark, sf).select(*INDEX_COLUMNS)


def q_chunk_keys(spark, sf):
    return _built(spark, sf).select("file", "chunk", "chunk_id", "file_mtime_key")


def q_corpus_stats(spark, sf):
    return corpus_stats(_built(spark, sf))


def q_embed_chunks(spark, sf):
    return _built(spark, sf, embed=hash_embed).select("chunk_id", "embedding")


def q_corpus_labels(spark, sf):
    texts, roots = _doc_texts(spark, sf)
    return corpus_labels(texts.select("path"), roots).select("path", "repo", "rel_path")


def q_unchanged_files(spark, sf):
    texts, _ = _doc_texts(spark, sf)
    seen = texts.where(F.col("doc_id") % 3 != 2).select(
        "path", F.when(F.col("doc_id") % 3 == 0, F.col("mtime")).otherwise(F.concat("mtime", F.lit(".old"))).alias("mtime"))
    index_keys = seen.select(file_mtime_key("path", "mtime").alias("file_mtime_key"))
    return unchanged_files(texts.select("path", "mtime"), index_keys).select("path", "mtime")


def q_snippet(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", snippet("text").alias("snippet"))


def _vectors(spark, sf):
    corpus, query, docs = fixtures(spark, sf, "fx_corpus", "fx_query", "documents")
    index = (corpus.join(docs.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id", "left")
             .withColumn("chunk", F.lit(0).cast("bigint")).withColumn("total_chunks", F.lit(1).cast("bigint")))
    return query, index


def q_knn(spark, sf):
    query, index = _vectors(spark, sf)
    return knn(query, index, 5).select("query_id", "rank", "chunk_id", "score")


def q_knn_repo(spark, sf):
    query, index = _vectors(spark, sf)
    return knn(query, index, 5, where=F.col("repo") == "repo3", keep=["repo"]).select(
        "query_id", "rank", "chunk_id", "score", "repo")


def q_knn_postfilter(spark, sf):
    query, index = _vectors(spark, sf)
    return knn_postfilter(query, index, 5, ext="py").select("query_id", "rank", "chunk_id", "score", "rel_path")


def q_similarity_join(spark, sf):
    query, index = _vectors(spark, sf)
    return similarity_join(query, index, 0.25).select("query_id", "chunk_id", "score")


def q_search(spark, sf):
    query, index = _vectors(spark, sf)
    return search(query, index, k=5)


# ---------------------------------------------------------------- streaming (X-*) and file sources

def _scratch(spark, name):
    from tidemark.session import scratch_path
    return scratch_path(spark, name)


def _each_arrives(parts, in_dir, run):
    """Each part arrives as a folder of files, then ``run()`` takes it up: a batch per part."""
    for i, part in enumerate(parts):
        part.write.mode("overwrite").parquet(f"{in_dir}/{i:04d}")
        run()


def _listing_rows(listing, at, *more):
    return listing.select("source_name", "file_id", "file_name", "mime_type", "md5", "size",
                          at.cast("timestamp_ntz").alias("listed_at"), *more)


def q_stream_discover(spark, sf):
    from tidemark.streaming.jobs import stream_discover
    from tidemark.streaming.snapshots import read_version, write_version
    listing, catalog, _ = _sync_inputs(spark, sf)
    base = _scratch(spark, "stream-discover")
    write_version(catalog, f"{base}/catalog", 0, key=FILE_KEY, watch=["id"], sort_by=FILE_KEY)
    parted = listing.withColumn("part", F.col("doc_id") % 4)
    _listing_rows(parted, _as_of(catalog), "part").write.parquet(f"{base}/listing")
    rows = spark.read.parquet(f"{base}/listing")
    _each_arrives([rows.where(F.col("part") == i).drop("part") for i in range(4)], f"{base}/in", lambda: stream_discover(
        spark, f"{base}/in", f"{base}/catalog", f"{base}/ckpt", files_per_batch=None).awaitTermination())
    return read_version(spark, f"{base}/catalog").select(*CATALOG_COLUMNS)


def _two_snapshots(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    t1 = _as_of(catalog)
    t0 = t1 - F.make_dt_interval(days=F.lit(1))
    old = catalog.select("source_name", "file_id", "file_name", F.lit(None).cast("string").alias("mime_type"),
                         F.col("checksum").alias("md5"), "size", t0.cast("timestamp_ntz").alias("listed_at"))
    return [old, _listing_rows(listing, t1)]


def _run_to_parquet(stream_df, base):
    q = (stream_df.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()


def _snap_tag(df, spark, sf):
    _, catalog, _ = _sync_inputs(spark, sf)
    return df.select(*FILE_KEY, "md5", F.when(F.col("listed_at") == _as_of(catalog), 1).otherwise(0).alias("snap"))


def q_stream_changes(spark, sf):
    from tidemark.streaming.jobs import listing_stream, stream_changes
    base = _scratch(spark, "stream-changes")
    _each_arrives(_two_snapshots(spark, sf), f"{base}/in", lambda: _run_to_parquet(
        stream_changes(listing_stream(spark, f"{base}/in", files_per_batch=None)), base))
    return _snap_tag(spark.read.parquet(f"{base}/out"), spark, sf)


def q_stream_dedupe(spark, sf):
    from tidemark.streaming.jobs import listing_stream, stream_dedupe
    base = _scratch(spark, "stream-dedupe")
    _each_arrives(_two_snapshots(spark, sf), f"{base}/in", lambda: _run_to_parquet(
        stream_dedupe(listing_stream(spark, f"{base}/in", files_per_batch=None)), base))
    return _snap_tag(spark.read.parquet(f"{base}/out"), spark, sf)


def q_stream_stale(spark, sf):
    """Every catalog row is taken up, those now UPLOADED end five minutes later; then two later
    events move the clock on. Each part is one run of the stream from the same checkpoint."""
    from tidemark.streaming.jobs import stream_stale
    _, catalog, _ = _sync_inputs(spark, sf)
    base, schema = _scratch(spark, "stream-stale"), "source_name string, file_id string, status string, ts timestamp"
    at = F.col("updated_at").cast("timestamp")
    taken = catalog.select(*FILE_KEY, F.lit("PROCESSING").alias("status"), at.alias("ts"))
    ended = catalog.where(F.col("status") == "UPLOADED").select(
        *FILE_KEY, "status", (at + F.make_dt_interval(mins=F.lit(5))).alias("ts"))
    clock = catalog.agg(F.max(at).alias("ts")).select(
        F.lit("clock").alias("source_name"), F.lit("tick").alias("file_id"), F.lit("NEW").alias("status"), "ts")
    later = [clock.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(n))) for n in (2, 3)]
    for i, part in enumerate([taken.unionByName(ended), *later]):
        part.write.parquet(f"{base}/in/{i}")
        events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        _run_to_parquet(stream_stale(events), base)
    return spark.read.parquet(f"{base}/out").select(*FILE_KEY, "stale")


def _doc_files(spark, sf, name):
    from tidemark.sources.materialize import materialize_documents
    root = _scratch(spark, name)
    materialize_documents(table(spark, sf, "documents"), root)
    return root


def q_scan_corpus(spark, sf):
    from tidemark.sources.corpus import scan_corpus
    root = _doc_files(spark, sf, "corpus")
    files = scan_corpus(spark, [root])
    base = root[5:] if root.startswith("file:") else root
    return files.select(F.regexp_replace("path", "^" + re.escape(base.rstrip("/") + "/"), "").alias("rel"), "size")


def q_scan_inventory(spark, sf):
    from tidemark.sources.corpus import scan_inventory
    root = _doc_files(spark, sf, "inventory")
    return scan_inventory(spark, root, prefix="src1")


def q_stream_index(spark, sf):
    from tidemark.streaming.jobs import stream_index
    from tidemark.streaming.snapshots import read_version
    root = _doc_files(spark, sf, "stream-index")
    base = _scratch(spark, "stream-index-out")
    roots = sorted(r for r in _source_dirs(spark, sf, root))
    stream_index(spark, root, f"{base}/index", f"{base}/ckpt", roots, files_per_batch=400).awaitTermination()
    idx = read_version(spark, f"{base}/index")
    return idx.select("rel_path", "repo", "chunk", "total_chunks", "text")


def _source_dirs(spark, sf, root):
    # The corpus roots: one per source folder (bounded by the number of sources).
    srcs = table(spark, sf, "documents").select("source").distinct().collect()
    base = root[5:] if root.startswith("file:") else root
    return [f"{base.rstrip('/')}/{r[0]}" for r in srcs]


def _config(listing):
    return listing.groupBy("source_name").agg(
        F.when(F.min("doc_id") % 3 == 0, F.lit("")).otherwise(F.md5(F.col("source_name"))).alias("folder_id"),
        F.when(F.min("doc_id") % 2 == 0, F.concat(F.lit("video/"), F.col("source_name"))).alias("object_prefix"))


def q_source_config(spark, sf):
    from tidemark.sources.listing import source_config
    listing, _, _ = _sync_inputs(spark, sf)
    c = source_config(_config(listing))
    return c.select("source_name", "folder_id", "object_prefix", "valid", F.array_join("violations", ",").alias("violations"))


def q_unknown_source(spark, sf):
    from tidemark.sources.listing import unknown_source
    listing, _, _ = _sync_inputs(spark, sf)
    pages = table(spark, sf, "pages")
    requests = pages.select(F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string")).alias("source_name"))
    return unknown_source(requests, _config(listing))


def q_config_diff(spark, sf):
    from tidemark.operators.setops import config_diff
    listing, catalog, _ = _sync_inputs(spark, sf)
    a = listing.groupBy("source_name").agg(F.min("file_id").alias("folder_id"))
    b = catalog.where(F.col("file_id").startswith("f")).groupBy("source_name").agg(F.min("file_id").alias("folder_id"))
    return config_diff(a, b)


def _listing_pages(spark, sf):
    """Pages of the listing, and pages of another listing that no first page leads to."""
    from tidemark.sources.listing import write_listing_pages
    listing, _, _ = _sync_inputs(spark, sf)
    root = _scratch(spark, "pages")
    write_listing_pages(listing.withColumn("trashed", F.col("doc_id") % 31 == 0), root)
    write_listing_pages(listing.where(F.col("doc_id") % 10 == 0), root, first_token="stray", mode="append")
    return root


def q_scan_listing_pages(spark, sf):
    from tidemark.sources.listing import scan_listing_pages
    return scan_listing_pages(spark, _listing_pages(spark, sf))


def q_listing_chain(spark, sf):
    from tidemark.sources.listing import listing_chain, read_pages
    return listing_chain(read_pages(spark, _listing_pages(spark, sf)))


def q_scan_catalog(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    path = _scratch(spark, "catalog")
    cat.write_snapshot(catalog.select(*CATALOG_COLUMNS), path)
    cat.upsert_partitions(path, listing, as_of=_as_of(catalog))
    return cat.scan_catalog(spark, path).select(*CATALOG_COLUMNS)


def q_stat_objects(spark, sf):
    _, catalog, inventory = _sync_inputs(spark, sf)
    s = stat_objects(catalog.select(*FILE_KEY, "object_key"), inventory)
    return s.select(*FILE_KEY, "object_key", "object_size", meta_checksum("metadata").alias("checksum"))


def q_point_lookup(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    doubled = catalog.unionByName(catalog.where(F.col("id") % 50 == 0))
    return point_lookup(doubled, listing).select(*FILE_KEY, "n_rows", "id", "status", "object_key")


def q_fetch_metadata(spark, sf):
    listing, catalog, _ = _sync_inputs(spark, sf)
    return fetch_metadata(listing, catalog.where(F.col("status") == "FAILED")).select(
        *FILE_KEY, "file_name", "md5", "size")


def q_meta_file_id(spark, sf):
    listing, _, _ = _sync_inputs(spark, sf)
    d = F.col("doc_id") % 4
    key = (F.when(d == 0, F.lit("x-amz-meta-drive_file_id")).when(d == 1, F.lit("X-Amz-Meta-Drive-File-Id"))
           .when(d == 2, F.lit("drive_file_id")).otherwise(F.lit("checksum")))
    return listing.select("doc_id", meta_file_id(F.create_map(key, F.col("file_id"))).alias("meta_file_id"))


def _index_runs(spark, sf):
    """Two runs of the index job over files: all of them, then those that changed in between, of
    which some have outgrown the size limit. The second run is one delta of the stored index."""
    from tidemark.plans.index import build_index
    from tidemark.sources.materialize import document_rel_path, write_text_files
    from tidemark.streaming.snapshots import read_version, write_batch, write_version
    root, store = _doc_files(spark, sf, "index-job"), _scratch(spark, "index-store")
    roots = sorted(_source_dirs(spark, sf, root))
    write_version(build_index(spark, roots).index, store, 0, key=["file"])
    grown = F.col("doc_id") % 500 == 1
    changed = table(spark, sf, "documents").where((F.col("doc_id") % 3 == 0) | grown)
    often = F.ceil(F.lit(MAX_BYTES + 1) / (F.length("text") + 1)).cast("int")
    text = F.when(grown, F.expr("repeat(concat(text, ' '), often)")).otherwise(F.concat(F.col("text"), F.lit(" v2")))
    write_text_files(changed.withColumn("often", often).select(document_rel_path().alias("rel"), text.alias("text")), root).count()
    run = build_index(spark, roots, index=read_version(spark, store), prune=True)
    write_batch(run.changes, store, gone=run.gone)
    return run, read_version(spark, store), root


#: A lower size limit, for the query that lists the files above one.
JOB_MAX_BYTES = 20_000


def q_index_job(spark, sf):
    _, index, _ = _index_runs(spark, sf)
    return index.select("rel_path", "repo", "chunk", "total_chunks", "text")


def q_index_job_counts(spark, sf):
    run, _, _ = _index_runs(spark, sf)
    return run.counts


def q_oversized_files(spark, sf):
    from tidemark.sources.corpus import oversized_files
    root = _doc_files(spark, sf, "oversized")
    base = root[5:] if root.startswith("file:") else root
    over = oversized_files(spark, [root], max_bytes=JOB_MAX_BYTES)
    return over.select(F.regexp_replace("path", "^" + re.escape(base.rstrip("/") + "/"), "").alias("rel"), "size")


def q_knn_approx(spark, sf):
    from tidemark.operators.retrieval import knn_approx
    query, index = _vectors(spark, sf)
    return knn_approx(query, index, 5)


# ---------------------------------------------------------------- boards and runs (D-*)

def q_stable_change(spark, sf):
    frames, = fixtures(spark, sf, "fx_frames")
    cells = frames.select((F.col("file_no") % 20).alias("board"), (F.col("file_no") * 4 + F.col("sample_no")).alias("frame"),
                          "scale", F.posexplode("pixels").alias("cell", "pixel"))
    cells = cells.withColumn("difference", F.abs(F.col("scale") * F.col("pixel").cast("double")))
    return boards.stable_change(cells, ["board", "cell"], "frame")


def q_grid_offset(spark, sf):
    x, y = (F.get("embedding", F.lit(k)).cast("double") for k in (0, 1))
    points = table(spark, sf, "embeddings").select(
        "label", (F.lit(200.0) + 4 * F.col("label") + 100 * x).alias("x"), (F.lit(240.0) + 100 * y).alias("y"))
    return boards.grid_offset(points, ["label"]).select(
        "label", *[F.round(c, 6).alias(c) for c in ("offset_x", "offset_y", "dx", "dy")])


def q_merge_predictions(spark, sf):
    d = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    one = docs.where(d % 5 != 0).select("doc_id", F.col("lang").alias("value"), F.when(
        d % 17 != 0, (d * 37 % 101).cast("double") / 100).alias("confidence"))
    two = docs.where(d % 10 == 1).select("doc_id", F.concat("lang", F.lit("2")).alias("value"),
                                         ((d * 41 % 101).cast("double") / 100).alias("confidence"))
    other = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"),
                                              ((d * 53 % 101).cast("double") / 100).alias("confidence"))
    return boards.merge_predictions(one.unionByName(two), other, ["doc_id"])


def q_sweep_leaderboard(spark, sf):
    flag, status = (F.lit("flag"), F.col("l_returnflag")), (F.lit("status"), F.col("l_linestatus"))
    tax = (F.lit("tax;rate"), F.round(F.col("l_tax") * 100).cast("int").cast("string"))
    params = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(*flag, *status, *tax)).otherwise(F.create_map(*tax, *flag, *status))
    runs = table(spark, sf, "lineitem").select(
        params.alias("params"), (F.col("l_suppkey") % 8).alias("board"), F.col("l_quantity").cast("long").alias("moves"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"))
    return boards.sweep_leaderboard(runs)


def q_orient_board(spark, sf):
    piece = F.transform("embedding", lambda e: F.when(e > 0.1, "P").when(e < -0.1, "p").otherwise("."))
    frames = table(spark, sf, "embeddings").select("label", "vec_id", piece.alias("cells"))
    return boards.orient_board(frames, "label", "vec_id").withColumn("cells", F.array_join("cells", ""))


def registry() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name, fn in list(globals().items()):
        if name.startswith("q_") and callable(fn):
            out[name[2:]] = fn
    return out
