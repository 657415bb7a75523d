"""Byte diagnostics (K-05), media validation (K-06) and quarantine (K-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.checksums import normalize_checksum
from tidemark.functions.formatting import duration_message, too_small_message, variance_message
from tidemark.functions.probe import parse_probe
from tidemark.functions.sizes import MIB, SAMPLE_POINTS, chunk_ranges
from tidemark.operators.catalog import apply_outcomes
from tidemark.operators.integrity import (
    all_ranges_match, content_hash, frame_verdict, hash_compare, pixel_stddev, range_hashes, read_ranges,
)
from tidemark.session import scratch_path

# Byte-diagnostic verdicts (store names generalised).
MISSING_KEY = "missing_store_key"
MISSING_OBJECT = "missing_store_object"
BYTES_DIFFER = "bytes_differ_upload_or_storage_suspect"
METADATA_MISMATCH = "metadata_mismatch_upload_or_storage_suspect"
BYTES_MATCH = "bytes_match_hook_or_splitter_suspect"
SAMPLED_MATCH = "sampled_bytes_match_run_full_for_proof"
INCONCLUSIVE = "inconclusive"

# Validation defaults (5 MiB, 5 s, frame check on, std-dev 8.0).
MIN_SIZE = 5 * MIB
MIN_DURATION = 5.0
MIN_VARIANCE = 8.0


def diagnose_bytes(files: DataFrame, source: DataFrame, store: DataFrame, *, key: str,
                   content: str = "content", mode: str = "chunks", chunk: int = MIB) -> tuple[DataFrame, DataFrame]:
    """K-05: compare the source and stored copies of each file.

    ``files``: ``key, object_key, source_size, source_md5, meta_checksum``; ``source`` and
    ``store``: ``key, content`` (a missing store row = missing object). Returns (per-file
    report, per-range comparison). Missing keys, missing objects and size mismatches get their
    verdict without any hashing being used.
    """
    if mode not in ("chunks", "full"):
        raise ValueError("mode must be 'chunks' or 'full'")
    full = mode == "full"
    store_sizes = store.select(key, F.length(content).cast("bigint").alias("store_size"))
    f = files.join(store_sizes, key, "left")
    size_match = F.when(F.col("store_size").isNotNull(), F.col("source_size") == F.col("store_size"))
    md5_match = F.when((F.coalesce(F.col("source_md5"), F.lit("")) != "")
                       & (F.coalesce(F.col("meta_checksum"), F.lit("")) != ""),
                       normalize_checksum("source_md5") == normalize_checksum("meta_checksum"))
    f = f.withColumn("size_match", size_match).withColumn("metadata_md5_match", md5_match)

    src_h = range_hashes(source, key, content, chunk)
    dst_h = range_hashes(store, key, content, chunk)
    # Only files whose verdict depends on the bytes take part in the comparison.
    hashed = f.where((F.coalesce(F.col("object_key"), F.lit("")) != "") & F.col("size_match")).select(key)
    compared = hash_compare(src_h.join(hashed, key, "left_semi"), dst_h, key) if not full else None
    if full:
        s_full = source.select(key, content_hash(content).alias("s_full"))
        d_full = store.select(key, content_hash(content).alias("d_full"))
        fm = hashed.join(s_full, key, "left").join(d_full, key, "left").select(
            key, F.when(hashed[key].isNotNull(), F.coalesce(F.col("s_full") == F.col("d_full"), F.lit(False)))
            .alias("full_sha256_match"))
        f = f.join(fm, key, "left").withColumn("n_ranges", F.lit(0).cast("bigint")) \
             .withColumn("ranges_matched", F.lit(0).cast("bigint")) \
             .withColumn("any_mismatch", F.lit(False)).withColumn("all_match", F.lit(None).cast("boolean"))
        compared = src_h.limit(0).select(key, "name", "offset", "length", F.lit(None).cast("string").alias("source_sha256"),
                                          F.lit(None).cast("string").alias("store_sha256"), F.lit(None).cast("boolean").alias("match"))
    else:
        agg = all_ranges_match(compared, key)
        f = f.join(agg, key, "left").withColumn("full_sha256_match", F.lit(None).cast("boolean"))
    return _report(f, key, mode), compared


def _report(f: DataFrame, key: str, mode: str, unread: str | None = None) -> DataFrame:
    """The report columns of K-05; column ``unread`` marks files of which a range could not be read."""
    n = F.coalesce(F.col("n_ranges"), F.lit(0))
    verdict = (F.when(F.coalesce(F.col("object_key"), F.lit("")) == "", F.lit(MISSING_KEY))
               .when(F.col("store_size").isNull(), F.lit(MISSING_OBJECT))
               .when(~F.col("size_match"), F.lit(BYTES_DIFFER))
               .when(F.coalesce(F.col(unread), F.lit(False)) if unread else F.lit(False), F.lit(INCONCLUSIVE))
               .when(F.coalesce(~F.col("full_sha256_match"), F.lit(False)), F.lit(BYTES_DIFFER))
               .when(F.coalesce(F.col("any_mismatch"), F.lit(False)), F.lit(BYTES_DIFFER))
               .when(F.coalesce(~F.col("metadata_md5_match"), F.lit(False)), F.lit(METADATA_MISMATCH))
               .when(F.coalesce(F.col("full_sha256_match"), F.lit(False)), F.lit(BYTES_MATCH))
               .when((n > 0) & F.coalesce(F.col("all_match"), F.lit(False)), F.lit(SAMPLED_MATCH))
               .otherwise(F.lit(INCONCLUSIVE)))
    return f.select(key, "object_key", "source_size", "store_size", "size_match", "metadata_md5_match",
                    n.cast("bigint").alias("n_ranges"),
                    F.coalesce(F.col("ranges_matched"), F.lit(0)).cast("bigint").alias("ranges_matched"),
                    "full_sha256_match", verdict.alias("verdict"), F.lit(mode).alias("mode"))


def diagnose_files(files: DataFrame, source: DataFrame, store: DataFrame, *, key: str, mode: str = "chunks",
                   chunk: int = MIB) -> tuple[DataFrame, DataFrame]:
    """K-05 over files that are read by seeking: sizes decide first, ranges are read second.

    ``files``: ``key, object_key, source_size, source_md5, meta_checksum``; ``source`` and
    ``store``: ``key, path, size`` (and ``base``, where the object begins inside a larger file;
    0 if there is none) from listing and inventory. Stage one joins these small rows. Only files
    with an object key and equal sizes go on the work list, which is written to the shared
    folder: one row per range and copy, so ranges of one huge file go to many tasks and a lost
    executor re-reads its own ranges only. Stage two opens exactly the files on the list.
    Returns the report, and the ranges compared (with ``full``, one range of the whole file).
    A range that cannot be read makes the verdict inconclusive; its error is in the ranges.
    """
    if mode not in ("chunks", "full"):
        raise ValueError("mode must be 'chunks' or 'full'")
    full = mode == "full"
    sizes = store.select(key, F.col("size").cast("bigint").alias("store_size"))
    f = files.join(sizes, key, "left")
    f = (f.withColumn("size_match", F.when(F.col("store_size").isNotNull(), F.col("source_size") == F.col("store_size")))
         .withColumn("metadata_md5_match", F.when(
             (F.coalesce(F.col("source_md5"), F.lit("")) != "") & (F.coalesce(F.col("meta_checksum"), F.lit("")) != ""),
             normalize_checksum("source_md5") == normalize_checksum("meta_checksum"))))
    wanted = f.where((F.coalesce(F.col("object_key"), F.lit("")) != "") & F.col("size_match")).select(key)
    ranges = (F.array(F.struct(F.lit("full").alias("name"), F.lit(0).cast("bigint").alias("offset"), F.col("size").alias("length")))
              if full else chunk_ranges("size", chunk))

    def listed(side: DataFrame, name: str) -> DataFrame:
        base = F.col("base") if "base" in side.columns else F.lit(0)
        rows = side.select(key, "path", base.cast("bigint").alias("base"), F.col("size").cast("bigint").alias("size"))
        return (rows.join(wanted, key, "left_semi").withColumn("r", F.explode(ranges))
                .select(key, F.lit(name).alias("side"), "path", F.col("r.name").alias("name"), F.col("r.offset").alias("start"),
                        (F.col("base") + F.col("r.offset")).alias("offset"), F.col("r.length").alias("length")))

    spark = files.sparkSession
    listed_at = scratch_path(spark, "seek-plan")
    listed(source, "source").unionByName(listed(store, "store")).write.parquet(listed_at)
    work = spark.read.parquet(listed_at).repartition(F.col(key), F.col("side"), F.col("name"))
    read_at = scratch_path(spark, "seek-hashes")
    read_ranges(work, keep=[key, "side", "start"]).write.parquet(read_at)
    hashes = spark.read.parquet(read_at)
    one = hashes.where(F.col("side") == "source").select(key, "name", F.col("start").alias("offset"), "length",
                                                         F.col("sha256").alias("source_sha256"), F.col("read_error").alias("source_error"))
    two = hashes.where(F.col("side") == "store").select(key, "name", F.col("sha256").alias("store_sha256"), F.col("read_error").alias("store_error"))
    compared = one.join(two, [key, "name"], "full_outer").withColumn(
        "match", F.coalesce(F.col("source_sha256") == F.col("store_sha256"), F.lit(False)))
    found = compared.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("match").cast("int")).cast("bigint").alias("ranges_matched"),
        F.bool_or(~F.col("match")).alias("any_mismatch"), F.bool_and(F.col("match")).alias("all_match"),
        F.bool_or(F.coalesce("source_error", "store_error").isNotNull()).alias("unread"))
    if full:
        empty = F.col("size_match") & (F.col("store_size") == 0)  # nothing to read, nothing differs
        found = found.select(key, F.lit(0).cast("bigint").alias("n_ranges"), F.lit(0).cast("bigint").alias("ranges_matched"),
                             F.lit(False).alias("any_mismatch"), F.lit(None).cast("boolean").alias("all_match"),
                             F.col("all_match").alias("full_sha256_match"), "unread")
        f = f.join(found, key, "left").withColumn(
            "full_sha256_match", F.when(empty & (F.coalesce(F.col("object_key"), F.lit("")) != ""), F.lit(True)).otherwise(F.col("full_sha256_match")))
    else:
        f = f.join(found, key, "left").withColumn("full_sha256_match", F.lit(None).cast("boolean"))
    return _report(f, key, mode, "unread"), compared


def frame_samples(frames: DataFrame, key: str, min_variance: float = MIN_VARIANCE) -> DataFrame:
    """Per decoded sample: its relative offset, variance (A-06) and threshold."""
    thr = F.lit(min_variance)
    for rel, override in SAMPLE_POINTS:
        if override is not None:
            thr = F.when(F.abs(F.col("rel_offset") - rel) < 1e-9, F.lit(override)).otherwise(thr)
    scale = F.col("scale") if "scale" in frames.columns else F.lit(1.0)
    return frames.select(key, F.col("rel_offset").alias("rel"),
                         pixel_stddev("pixels", scale).alias("variance"), thr.cast("double").alias("min_variance"))


def validate_media(files: DataFrame, probes: DataFrame, frames: DataFrame | None, *, key: str,
                   min_size: int = MIN_SIZE, min_duration: float = MIN_DURATION, frame_check: bool = True,
                   min_variance: float = MIN_VARIANCE) -> DataFrame:
    """K-06: size, probe, duration and frame checks in order; the first failure is the reason.

    ``files``: ``key, file_size``; ``probes``: ``key, probe_json`` (NULL = probe failed);
    ``frames``: ``key, rel_offset, pixels[, scale]`` (NULL pixels = frame not decodable, the
    sample is skipped - the code's behaviour, trap T4). Files without samples pass the frame
    check.
    """
    p = probes.select(key, parse_probe("probe_json").alias("p"))
    f = files.join(p, key, "left")
    if frame_check and frames is not None:
        f = f.join(frame_verdict(frame_samples(frames, key, min_variance), key), key, "left")
    else:
        f = (f.withColumn("failed", F.lit(None).cast("struct<rel:double,variance:double,min_variance:double>"))
             .withColumn("last_variance", F.lit(None).cast("double")))
    too_small = F.col("file_size") < min_size
    no_probe = F.col("p").isNull() | ~F.col("p.probed")
    no_video = ~F.col("p.has_video")
    dur = F.col("p.duration_sec")
    short = dur.isNotNull() & (dur < min_duration)
    frame_fail = F.col("failed").isNotNull()
    reason = (F.when(too_small, too_small_message("file_size", min_size))
              .when(no_probe, F.lit("probe failed"))
              .when(no_video, F.lit("probe: no video stream found"))
              .when(short, duration_message(dur, min_duration))
              .when(frame_fail, variance_message("failed.rel", "failed.variance", "failed.min_variance")))
    probed = ~(too_small | no_probe | no_video)
    variance = (F.when(~probed | short, F.lit(None).cast("double"))
                .when(frame_fail, F.col("failed.variance")).otherwise(F.col("last_variance")))
    return f.select(
        key, reason.isNull().alias("ok"), reason.alias("reason"),
        F.when(probed, dur).alias("duration_sec"), F.when(probed, F.col("p.codec")).alias("codec"),
        F.when(probed, F.col("p.width")).alias("width"), F.when(probed, F.col("p.height")).alias("height"),
        variance.alias("variance"))


def quarantine(catalog: DataFrame, validations: DataFrame, *, as_of) -> DataFrame:
    """K-07: files that failed validation become CORRUPTED with the reason; validation errors
    (``ok`` NULL) leave the row alone."""
    outcomes = validations.where(F.col("ok") == F.lit(False)).select(
        "source_name", "file_id", F.lit("corrupted").alias("outcome"), F.lit(None).cast("string").alias("checksum"),
        F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("object_key"),
        F.col("reason").alias("message"))
    return apply_outcomes(catalog, outcomes, as_of=as_of)
