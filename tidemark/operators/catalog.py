"""Catalog table updates (S-01..S-08) and ordered reads (W-01..W-04).

Parquet has no MERGE, so each update is "join, project, write a new snapshot": the
functions return the whole next catalog as a DataFrame and ``write_snapshot`` stores it in
a fresh folder (never the folder being read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from tidemark.functions.checksums import checksum_changed
from tidemark.functions.paths import object_key
from tidemark.functions.predicates import (
    CORRUPTED, FAILED, NEW, PROCESSING, STALE_SECONDS, UPLOADED, as_time, cursor_after, file_filter,
)
from tidemark.functions.sizes import effective_size
from tidemark.operators.joins import FILE_KEY, with_config
from tidemark.operators.ranking import global_rank, group_rank, stored

CATALOG_COLUMNS = ["id", "source_name", "file_id", "file_name", "checksum", "size", "status", "object_key",
                   "attempt_count", "last_error", "created_at", "updated_at"]
CATALOG_SCHEMA = (
    "id long, source_name string, file_id string, file_name string, checksum string, size long, status string, "
    "object_key string, attempt_count int, last_error string, created_at timestamp_ntz, updated_at timestamp_ntz")
MAX_ERROR_CHARS = 4000
STALE_RESET_ERROR = "stale_processing_reset"


def _cols(catalog: DataFrame) -> list[str]:
    extra = ["status_changed_at"] if "status_changed_at" in catalog.columns else []
    return CATALOG_COLUMNS + extra


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W-01: keep the last row per key by ``order`` (ties must not occur).

    An aggregate, not a window: the partial ``max_by`` collapses a hot key on the map side
    before the shuffle, so a key holding a third of the rows costs no straggler task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_w"))
    return picked.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest])


def assign_ids(new_rows: DataFrame, max_id: Column | int, order: list[str] | None = None,
               id_col: str = "id") -> DataFrame:
    """S-07: ids ``max_id + 1, max_id + 2, ...`` in key order, without a global window."""
    order = order or FILE_KEY
    ranked = global_rank(new_rows.drop(id_col) if id_col in new_rows.columns else new_rows, order, "_rank")
    base = max_id if isinstance(max_id, Column) else F.lit(max_id)
    return ranked.withColumn(id_col, (F.coalesce(base, F.lit(0)) + F.col("_rank")).cast("bigint")).drop("_rank")


def upsert_discovered(catalog: DataFrame, listing: DataFrame, config: DataFrame | None = None, *, as_of,
                      order_col: str | None = None, requeue: bool = False, max_id: Column | int | None = None) -> DataFrame:
    """S-01 (with S-06 fused when ``requeue``): the next catalog after one discovery.

    ``max_id`` is the highest id given so far, for catalogs of which only a part is passed in.

    Unseen files come in as NEW with 0 attempts and fresh ids; seen ones get the listed name,
    checksum, size, key and ``updated_at``; unlisted rows stay. With ``requeue`` an UPLOADED or
    CORRUPTED row whose checksum changed against its pre-upsert value becomes NEW (trap T1).
    """
    t = as_time(as_of)
    # Always one row per key: the last listed one, or without a time the largest by its values.
    order = [order_col] if order_col else ["listed_at"] if "listed_at" in listing.columns else []
    lst = last_wins(listing, FILE_KEY, order + sorted(c for c in listing.columns if c not in FILE_KEY and c not in order))
    lst = with_config(lst, config)
    name = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.lit("unnamed"))
    lst = lst.select(
        *FILE_KEY, name.alias("l_file_name"), F.col("md5").alias("l_checksum"),
        effective_size(F.col("size")).alias("l_size"),
        object_key("source_name", "file_id", name, "object_prefix").alias("l_object_key"),
        F.lit(True).alias("l_present"),
    )
    cols = _cols(catalog)
    cat = catalog.select(*FILE_KEY, *[F.col(c).alias(f"c_{c}") for c in cols if c not in FILE_KEY],
                         F.lit(True).alias("c_present"))
    j = cat.join(lst, FILE_KEY, "full_outer")
    in_l, in_c = F.col("l_present").isNotNull(), F.col("c_present").isNotNull()
    status = F.when(in_c, F.col("c_status")).otherwise(F.lit(NEW))
    if requeue:
        changed = in_c & in_l & F.col("c_status").isin(UPLOADED, CORRUPTED) & checksum_changed(
            F.col("c_checksum"), F.col("l_checksum"))
        status = F.when(changed, F.lit(NEW)).otherwise(status)
    else:
        changed = F.lit(False)
    out = {
        "id": F.col("c_id"),
        "source_name": F.col("source_name"),
        "file_id": F.col("file_id"),
        "file_name": F.when(in_l, F.col("l_file_name")).otherwise(F.col("c_file_name")),
        "checksum": F.when(in_l, F.col("l_checksum")).otherwise(F.col("c_checksum")),
        "size": F.when(in_l, F.col("l_size")).otherwise(F.col("c_size")),
        "status": status,
        "object_key": F.when(in_l, F.col("l_object_key")).otherwise(F.col("c_object_key")),
        "attempt_count": F.when(in_c, F.col("c_attempt_count")).otherwise(F.lit(0)).cast("int"),
        "last_error": F.col("c_last_error"),
        "created_at": F.when(in_c, F.col("c_created_at")).otherwise(t),
        "updated_at": F.when(in_l, t).otherwise(F.col("c_updated_at")),
    }
    if "status_changed_at" in cols:
        out["status_changed_at"] = F.when(in_c & ~changed, F.col("c_status_changed_at")).otherwise(t)
    merged = j.select(*[v.alias(k) for k, v in out.items()])
    max_id = catalog.select(F.max("id")).scalar() if max_id is None else max_id
    seen = merged.where(F.col("id").isNotNull())
    fresh = assign_ids(merged.where(F.col("id").isNull()), max_id)
    return seen.unionByName(fresh.select(*cols))


def requeue_changed(old_catalog: DataFrame, new_catalog: DataFrame, *, as_of) -> DataFrame:
    """S-06: rows UPLOADED or CORRUPTED whose checksum changed against the pre-upsert row,
    set to NEW (the rows only)."""
    old = old_catalog.select(*FILE_KEY, F.col("checksum").alias("_old_checksum"))
    j = new_catalog.join(old, FILE_KEY, "inner")
    hit = F.col("status").isin(UPLOADED, CORRUPTED) & checksum_changed(F.col("_old_checksum"), F.col("checksum"))
    out = j.where(hit).drop("_old_checksum").withColumn("status", F.lit(NEW)).withColumn("updated_at", as_time(as_of))
    if "status_changed_at" in out.columns:
        out = out.withColumn("status_changed_at", as_time(as_of))
    return out


def apply_outcomes(catalog: DataFrame, outcomes: DataFrame, *, as_of) -> DataFrame:
    """S-02, S-03, S-04: apply per-file outcomes ``ok``, ``failed`` or ``corrupted``.

    ``outcomes``: ``source_name, file_id, outcome, checksum, size, object_key, message``
    (one row per file). ok: UPLOADED, stored checksum/size/key, error cleared, attempts 0;
    failed: FAILED, error cut to 4000 characters, attempts + 1; corrupted: CORRUPTED, reason
    cut to 4000 characters, attempts unchanged.
    """
    t = as_time(as_of)
    cols = _cols(catalog)
    o = outcomes.select(*FILE_KEY, F.col("outcome").alias("_o"), F.col("checksum").alias("_ck"),
                        F.col("size").cast("bigint").alias("_sz"), F.col("object_key").alias("_key"),
                        F.col("message").alias("_msg"))
    j = catalog.join(o, FILE_KEY, "left")
    ok, failed, corrupted = F.col("_o") == "ok", F.col("_o") == "failed", F.col("_o") == "corrupted"
    hit = F.col("_o").isin("ok", "failed", "corrupted")
    cut = F.coalesce(F.col("_msg"), F.lit("")).substr(F.lit(1), F.lit(MAX_ERROR_CHARS))
    reason = F.coalesce(F.nullif(F.col("_msg"), F.lit("")), F.lit("validation failed")).substr(
        F.lit(1), F.lit(MAX_ERROR_CHARS))
    out = {c: F.col(c) for c in cols}
    out["status"] = (F.when(ok, F.lit(UPLOADED)).when(failed, F.lit(FAILED)).when(corrupted, F.lit(CORRUPTED))
                     .otherwise(F.col("status")))
    out["checksum"] = F.when(ok, F.col("_ck")).otherwise(F.col("checksum"))
    out["size"] = F.when(ok, F.col("_sz")).otherwise(F.col("size"))
    out["object_key"] = F.when(ok, F.col("_key")).otherwise(F.col("object_key"))
    out["last_error"] = (F.when(ok, F.lit(None).cast("string")).when(failed, cut).when(corrupted, reason)
                         .otherwise(F.col("last_error")))
    out["attempt_count"] = (F.when(ok, F.lit(0)).when(failed, F.col("attempt_count") + 1)
                            .otherwise(F.col("attempt_count"))).cast("int")
    out["updated_at"] = F.when(F.coalesce(hit, F.lit(False)), t).otherwise(F.col("updated_at"))
    if "status_changed_at" in cols:
        out["status_changed_at"] = F.when(F.coalesce(hit, F.lit(False)), t).otherwise(F.col("status_changed_at"))
    return j.select(*[v.alias(k) for k, v in out.items()])


def reset_stale(catalog: DataFrame, *, as_of, older_than: int = STALE_SECONDS,
                age_col: str = "updated_at") -> tuple[DataFrame, Observation]:
    """S-05: PROCESSING rows older than the limit become FAILED with error
    ``stale_processing_reset`` (attempts unchanged). The Observation's ``reset`` metric holds
    the number of rows reset once the frame has been computed."""
    t = as_time(as_of)
    stale = F.coalesce((F.col("status") == PROCESSING)
                       & (F.col(age_col) < t - F.make_dt_interval(secs=F.lit(older_than))), F.lit(False))
    out = (catalog.withColumn("_stale", stale)
           .withColumn("status", F.when(F.col("_stale"), F.lit(FAILED)).otherwise(F.col("status")))
           .withColumn("last_error", F.when(F.col("_stale"), F.lit(STALE_RESET_ERROR)).otherwise(F.col("last_error")))
           .withColumn("updated_at", F.when(F.col("_stale"), t).otherwise(F.col("updated_at"))))
    if "status_changed_at" in catalog.columns:
        out = out.withColumn("status_changed_at",
                             F.when(F.col("_stale"), t).otherwise(F.col("status_changed_at")))
    obs = Observation("reset_stale")
    out = out.observe(obs, F.sum(F.col("_stale").cast("long")).alias("reset"))
    return out.drop("_stale"), obs


def reconcile_from_store(plan: DataFrame, catalog: DataFrame, *, as_of) -> DataFrame:
    """S-08: files proven present in the store but not UPLOADED are marked UPLOADED."""
    outcomes = plan.where(F.col("action") == "RECONCILE").select(
        *FILE_KEY, F.lit("ok").alias("outcome"), "checksum", "size", "object_key",
        F.lit(None).cast("string").alias("message"))
    return apply_outcomes(catalog, outcomes, as_of=as_of)


def files_page(catalog: DataFrame, *, source_name: str | None = None, status: str | None = None,
               name_contains: str | None = None, cursor_updated_at=None, cursor_id: int | None = None,
               limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """W-02: newest-first page by ``(updated_at, id)`` and the next cursor.

    Fetches ``limit + 1`` rows (a ``TakeOrderedAndProject``: each partition keeps its top
    rows, so nothing but ``limit + 1`` rows is ever gathered); the cursor row exists only
    when there is more.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be within 1..200")
    top = (catalog.where(file_filter(source_name, status, name_contains) & cursor_after(cursor_updated_at, cursor_id))
           .orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(limit + 1))
    # ``top`` holds at most 201 rows; numbering it is bounded work.
    numbered = top.withColumn("_n", F.row_number().over(Window.orderBy(F.col("updated_at").desc(),
                                                                       F.col("id").desc())))
    page = numbered.where(F.col("_n") <= limit).drop("_n")
    more = numbered.where(F.col("_n") == limit + 1).select(F.lit(1).alias("_more"))
    cursor = (numbered.where(F.col("_n") == limit).join(more, how="left_semi")
              .select(F.col("updated_at").alias("cursor_updated_at"), F.col("id").alias("cursor_id")))
    return page, cursor


def claim_next(catalog: DataFrame, *, as_of, source_name: str | None = None, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """W-03: the ``n`` oldest NEW or FAILED rows become PROCESSING. Returns (claimed rows,
    next catalog). The claimed keys are joined back on the file key."""
    t = as_time(as_of)
    cond = F.col("status").isin(NEW, FAILED)
    if source_name:
        cond = cond & (F.col("source_name") == source_name)
    claimed = (catalog.where(cond).orderBy(F.col("updated_at").asc(), F.col("id").asc()).limit(n)
               .withColumn("status", F.lit(PROCESSING)).withColumn("updated_at", t))
    if "status_changed_at" in catalog.columns:
        claimed = claimed.withColumn("status_changed_at", t)
    keys = claimed.select(*FILE_KEY, F.lit(True).alias("_claimed"))
    j = catalog.join(keys, FILE_KEY, "left")
    hit = F.col("_claimed").isNotNull()
    nxt = (j.withColumn("status", F.when(hit, F.lit(PROCESSING)).otherwise(F.col("status")))
           .withColumn("updated_at", F.when(hit, t).otherwise(F.col("updated_at"))))
    if "status_changed_at" in catalog.columns:
        nxt = nxt.withColumn("status_changed_at", F.when(hit, t).otherwise(F.col("status_changed_at")))
    return claimed, nxt.drop("_claimed")


def resolve_by_name(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """W-04: exact-name lookup per ``(source_name, file_name)`` request.

    One row per candidate (``outcome`` = resolved or ambiguous, ``candidate_rank`` newest
    first by ``(updated_at, id)``) and one row with NULL candidate for ``not_found``. Counts
    and ranks come from one ``group_rank``, so a name shared by a third of the catalog never
    lands in one task; no candidate list is capped.
    """
    req = requests.select("source_name", "file_name").distinct()
    cand = catalog.select("source_name", "file_name", "file_id", "id", "size", "status",
                          "object_key", "updated_at").join(req, ["source_name", "file_name"], "left_semi")
    found = group_rank(cand, ["source_name", "file_name"], [F.col("updated_at").desc(), F.col("id").desc()],
                       "candidate_rank", count_col="n_matches")
    found = found.withColumn("outcome", F.when(F.col("n_matches") == 1, "resolved").otherwise("ambiguous"))
    missing = (req.join(catalog.select("source_name", "file_name").distinct(), ["source_name", "file_name"], "left_anti")
               .select("source_name", "file_name", F.lit("not_found").alias("outcome"),
                       F.lit(0).cast("bigint").alias("n_matches")))
    cols = ["source_name", "file_name", "outcome", "n_matches", "candidate_rank", "file_id", "id", "size",
            "status", "object_key", "updated_at"]
    return found.select(*cols).unionByName(missing, allowMissingColumns=True).select(*cols)


def filter_files(catalog: DataFrame, source_name: str | None = None, status: str | None = None,
                 name_contains: str | None = None) -> DataFrame:
    """F-01 applied to a catalog."""
    return catalog.where(file_filter(source_name, status, name_contains))


def count_files(catalog: DataFrame) -> DataFrame:
    """A-03."""
    return catalog.agg(F.count(F.lit(1)).alias("n_files"))


def key_violations(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A-10: keys that occur more than once (a partial aggregate, skew-proof)."""
    keys = keys or FILE_KEY
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def listing_projection(catalog: DataFrame, view: str = "files") -> DataFrame:
    """P-20: the 12-column files view or the 6-column candidate view."""
    if view == "files":
        return catalog.select(*CATALOG_COLUMNS)
    return catalog.select("file_id", "file_name", "size", "status", "object_key", "updated_at")


def _laid_out(df: DataFrame, partition_by: str):
    # Range partitioning on (source, file) splits a source that owns most files over many
    # writer tasks; hash partitioning on the source alone would give it one task.
    return (df.repartitionByRange(partition_by, "file_id").sortWithinPartitions(partition_by, "status", "file_id")
            .write.partitionBy(partition_by))


def write_snapshot(df: DataFrame, path: str, partition_by: str = "source_name") -> None:
    """Write a catalog snapshot to a new folder, partitioned by source and sorted by status
    within files (min/max statistics then serve the status filter)."""
    _laid_out(df, partition_by).mode("errorifexists").parquet(path)


def scan_catalog(spark: SparkSession, path: str, source_name: str | None = None, status: str | None = None,
                 schema: StructType | str = CATALOG_SCHEMA) -> DataFrame:
    """C-04: catalog rows as ``write_snapshot`` lays them out; only the folder of ``source_name``
    is listed and only row groups that may hold ``status`` are read."""
    rows = spark.read.schema(schema).parquet(path)
    if source_name is not None:
        rows = rows.where(F.col("source_name") == source_name)
    return rows if status is None else rows.where(F.col("status") == status)


def upsert_partitions(path: str, listing: DataFrame, config: DataFrame | None = None, *, as_of, **options) -> None:
    """S-01 on a partitioned catalog folder: only the sources that ``listing`` names are read,
    upserted and put in place of their old folders; the others are not touched.

    The new rows are written to scratch first, so the folder is not read while it changes. The
    folders of the sources are replaced one after the other: a run that is broken off there is to
    be repeated with the same listing and time, which gives the same rows. One writer at a time.
    """
    spark = listing.sparkSession
    whole = scan_catalog(spark, path)
    touched = listing.select("source_name").distinct()
    # A semi join on the partition column prunes folders at run time, whatever their number.
    old = whole.join(touched, "source_name", "left_semi")
    top = whole.select(F.max("id")).scalar()
    nxt = stored(upsert_discovered(old, listing, config, as_of=as_of, max_id=top, **options), "upserted")
    _laid_out(nxt, "source_name").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
