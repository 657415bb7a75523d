"""Three-way audit of listing, catalog and store (K-04 with J-04, U-01, U-04, A-01, A-02)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.checksums import meta_checksum, normalize_checksum
from tidemark.functions.paths import key_basename, key_prefix
from tidemark.functions.predicates import PROCESSING, UPLOADED
from tidemark.functions.sizes import effective_size
from tidemark.operators.joins import FILE_KEY, salt, salted
from tidemark.operators.ranking import stored

# Audit issue codes in report order.
MISSING_IN_STORE = "missing_in_store"
SIZE_MISMATCH = "size_mismatch"
CHECKSUM_MISMATCH = "checksum_mismatch"
NOT_IN_DB = "not_in_db"
DB_INCONSISTENT = "db_inconsistent"
ORPHANED_IN_STORE = "orphaned_in_store"

ITEM_COLUMNS = ["source_name", "file_id", "file_name", "source_md5", "source_size", "object_key",
                "object_size", "object_checksum", "status", "issues"]


@dataclass
class AuditReport:
    items: DataFrame     # one row per file or orphan with issues ARRAY<STRING>
    totals: DataFrame    # source_name, total_files, total_objects, synced_ok
    summary: DataFrame   # source_name, issue, n


def source_prefixes(config: DataFrame | None, listing: DataFrame) -> DataFrame:
    """Each audited source and its key prefix (the key rule: object_prefix, else the name)."""
    if config is None:
        cfg = listing.select("source_name").distinct().withColumn("object_prefix", F.lit(None).cast("string"))
    else:
        cfg = config.select("source_name", F.col("object_prefix").cast("string"))
    return cfg.select("source_name", key_prefix("source_name", "object_prefix").alias("prefix"))


def objects_under_prefixes(inventory: DataFrame, prefixes: DataFrame, mode: str = "string") -> DataFrame:
    """C-02 per source: objects whose key starts with the source's prefix.

    ``string`` is the plain string-prefix rule of a recursive store listing (``video/A`` also
    takes ``video/AB/..``); ``path`` requires the prefix to end at a ``/``. Evaluated as an equi
    join: each key is cut at every distinct prefix length (a scalar subquery over the config,
    a handful of values), so there is no nested-loop join against the config.
    """
    lengths = prefixes.select(F.sort_array(F.collect_set(F.length("prefix"))).alias("l")).scalar()
    cut = inventory.select("*", F.explode(lengths).alias("_len"))
    cut = cut.select("*", F.struct(F.col("_len").alias("_len"),
                                   F.col("object_key").substr(F.lit(1), F.col("_len")).alias("_cut")).alias("_c")).drop("_len")
    cut = cut.where(F.col("_c._cut") == F.col("object_key").substr(F.lit(1), F.col("_c._len")))
    if mode == "path":
        cut = cut.where((F.col("_c._len") == 0)
                        | (F.col("object_key").substr(F.col("_c._len") + 1, F.lit(1)) == "/"))
    elif mode != "string":
        raise ValueError("mode must be 'string' or 'path'")
    dealt = salted(prefixes)
    joined = cut.withColumn("_part", salt("object_key")).join(
        dealt, (F.col("_c._cut") == F.col("prefix")) & (F.length("prefix") == F.col("_c._len"))
        & (F.col("_part") == F.col("_salt")))
    return joined.drop("_c", "_part", "_salt", "prefix")


def audit_sources(listing: DataFrame, catalog: DataFrame, inventory: DataFrame,
                  config: DataFrame | None = None, *, full: bool = False, prefix_mode: str = "string") -> AuditReport:
    """K-04: per listed file the issue codes in order, plus orphaned objects, per source.

    ``listing`` must hold one row per ``(source_name, file_id)`` (see ``last_wins``).
    ``full`` adds the metadata checksum comparison (the inventory's ``metadata`` column is only
    read then).
    """
    prefixes = source_prefixes(config, listing)
    objs = objects_under_prefixes(inventory.select("object_key", "object_size",
                                                   *(["metadata"] if full and "metadata" in inventory.columns else [])),
                                  prefixes, prefix_mode)
    if config is None:  # every source of the listing is audited
        listed = listing.where(F.col("source_name").isNotNull())
    else:
        listed = listing.withColumn("_salt", salt(*FILE_KEY)).join(
            salted(prefixes.select("source_name")), ["source_name", "_salt"], "left_semi")
    files = listed.select(
        *FILE_KEY, F.coalesce(F.col("file_name"), F.lit("")).alias("file_name"),
        F.col("md5").alias("source_md5"), effective_size(F.col("size")).alias("source_size"))
    cat = catalog.select(*FILE_KEY, F.col("status"), F.col("object_key").alias("expected_key"))
    f = files.join(cat, FILE_KEY, "left")
    o_checksum = (meta_checksum("metadata") if full and "metadata" in objs.columns
                  else F.lit(None).cast("string"))
    o = objs.select("source_name", F.col("object_key").alias("expected_key"), F.col("object_key").alias("o_key"),
                    F.col("object_size").alias("o_size"), o_checksum.alias("o_checksum"))
    # NULL or empty stored keys never match an object.
    f = f.join(o, ["source_name", "expected_key"], "left")
    present = F.col("o_key").isNotNull()
    status = F.col("status")
    checks = [
        F.when(~present, F.lit(MISSING_IN_STORE)),
        F.when(present & (F.col("source_size") > 0) & (F.col("o_size") != F.col("source_size")), F.lit(SIZE_MISMATCH)),
    ]
    if full:
        checks.append(F.when(present & (F.coalesce(F.col("source_md5"), F.lit("")) != "")
                             & (F.coalesce(F.col("o_checksum"), F.lit("")) != "")
                             & (normalize_checksum("source_md5") != normalize_checksum("o_checksum")),
                             F.lit(CHECKSUM_MISMATCH)))
    checks.append(F.when(status.isNull(), F.lit(NOT_IN_DB))
                  .when((status == UPLOADED) & ~present, F.lit(DB_INCONSISTENT))
                  .when(~status.isin(UPLOADED, PROCESSING) & present, F.lit(DB_INCONSISTENT)))
    f = f.withColumn("issues", F.array_compact(F.array(*checks)))
    file_items = f.where(F.size("issues") > 0).select(
        *FILE_KEY, "file_name", "source_md5", "source_size", F.col("expected_key").alias("object_key"),
        F.col("o_size").alias("object_size"), F.col("o_checksum").alias("object_checksum"), "status", "issues")

    orphans = orphan_objects(objs, f.where(present).select("source_name", F.col("o_key").alias("object_key")),
                             catalog, files.select(*FILE_KEY))
    # Written once: the summary and the totals count from the items instead of joining again.
    items = stored(file_items.unionByName(orphans.select(*ITEM_COLUMNS)), "audit-items")

    summary = audit_summary(items)
    totals = audit_totals(prefixes.select("source_name"), files, objs, issue_set(items))
    return AuditReport(items=items.select(*ITEM_COLUMNS), totals=totals, summary=summary)


def orphan_objects(objs: DataFrame, matched: DataFrame, catalog: DataFrame, listed: DataFrame) -> DataFrame:
    """J-04: objects no listed file matched; owner by stored key from the catalog (``unknown``
    without one), kept only when the owner is not listed."""
    unmatched = objs.select("source_name", "object_key", "object_size").join(
        matched.distinct(), ["source_name", "object_key"], "left_anti")
    owners = (catalog.where(F.coalesce(F.col("object_key"), F.lit("")) != "")
              .groupBy("source_name", "object_key")
              .agg(F.max_by(F.struct("file_id", "file_name", "status"), F.col("id")).alias("_o")))
    o = unmatched.join(owners, ["source_name", "object_key"], "left")
    o = o.select(
        "source_name",
        F.coalesce(F.col("_o.file_id"), F.lit("unknown")).alias("file_id"),
        F.coalesce(F.col("_o.file_name"), key_basename("object_key")).alias("file_name"),
        F.lit(None).cast("string").alias("source_md5"), F.lit(0).cast("bigint").alias("source_size"),
        "object_key", F.col("object_size").alias("object_size"),
        F.lit(None).cast("string").alias("object_checksum"), F.col("_o.status").alias("status"),
        F.array(F.lit(ORPHANED_IN_STORE)).alias("issues"))
    return o.join(listed, FILE_KEY, "left_anti")


def audit_summary(items: DataFrame) -> DataFrame:
    """A-01: count per issue code over the exploded issue arrays."""
    return (items.select("source_name", F.explode("issues").alias("issue"))
            .groupBy("source_name", "issue").agg(F.count(F.lit(1)).alias("n")))


def audit_totals(audited: DataFrame, files: DataFrame, objs: DataFrame, file_items: DataFrame) -> DataFrame:
    """A-02: listed files, objects and ``synced_ok = max(0, files - files with issues)``."""
    nf = files.groupBy("source_name").agg(F.countDistinct("file_id").alias("total_files"))
    no = objs.groupBy("source_name").agg(F.countDistinct("object_key").alias("total_objects"))
    ni = file_items.groupBy("source_name").agg(F.countDistinct("file_id").alias("files_with_issues"))
    t = audited.join(nf, "source_name", "left").join(no, "source_name", "left").join(ni, "source_name", "left")
    return t.select(
        "source_name",
        F.coalesce("total_files", F.lit(0)).alias("total_files"),
        F.coalesce("total_objects", F.lit(0)).alias("total_objects"),
        F.greatest(F.lit(0), F.coalesce("total_files", F.lit(0)) - F.coalesce("files_with_issues", F.lit(0)))
        .cast("bigint").alias("synced_ok"))


def issue_set(items: DataFrame) -> DataFrame:
    """U-04: distinct listed files with any issue."""
    return items.where(~F.array_contains("issues", ORPHANED_IN_STORE)).select(*FILE_KEY).distinct()
