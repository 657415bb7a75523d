"""Sync planning (K-01), discovery (K-02) and transfer verification (K-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.checksums import checksum_changed, skip_from_store
from tidemark.functions.formatting import truncated_message
from tidemark.functions.mime import is_video_like
from tidemark.functions.paths import object_key
from tidemark.functions.predicates import (
    CORRUPTED, MAX_ATTEMPTS, NEW, STALE_SECONDS, UPLOADED, as_time, is_fresh, skip_from_catalog,
)
from tidemark.functions.sizes import effective_size
from tidemark.operators.joins import FILE_KEY, join_plan_inputs

# Plan actions in cascade order, and transfer reasons.
ACTIONS = ("NO_ROW", "BUSY", "SKIP_CORRUPTED", "NON_VIDEO", "ZERO", "SKIP_DB", "RECONCILE",
           "SKIP_STORE", "MAX_ATTEMPTS", "TRANSFER")
REASONS = ("size", "checksum", "missing", "new")

PLAN_COLUMNS = ["source_name", "file_id", "file_name", "checksum", "size", "object_key", "status",
                "action", "reason"]


def _effective_name(j: DataFrame) -> Column:
    # The listing's name unless it is NULL or empty, else the catalog's.
    return F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.col("c_file_name"))


def plan_sync(listing: DataFrame, catalog: DataFrame, inventory: DataFrame,
              config: DataFrame | None = None, *, as_of, stale_seconds: int = STALE_SECONDS,
              max_attempts: int = MAX_ATTEMPTS, age_col: str = "updated_at", with_flags: bool = False) -> DataFrame:
    """K-01: one action per listed file, first matching rule wins.

    ``listing``: ``source_name, file_id, file_name, mime_type, md5, size``;
    ``catalog``: the files table; ``inventory``: ``object_key, object_size[, metadata]``;
    ``config``: ``source_name, object_prefix`` (optional). ``age_col`` selects the column that
    ages PROCESSING rows (``status_changed_at`` where the table has it).
    """
    j = join_plan_inputs(
        listing, catalog, inventory, config,
        canonical_key=lambda d: object_key("source_name", "file_id", _effective_name(d), "object_prefix"),
    )
    status0 = F.col("c_status")
    changed = checksum_changed(F.col("c_checksum"), F.col("md5"))
    status = F.when((status0 == CORRUPTED) & changed, F.lit(NEW)).otherwise(status0)
    name = _effective_name(j)
    size = effective_size(F.col("size"), F.col("c_size"))
    exists = F.col("o_key").isNotNull()
    canon = F.col("canonical_key")

    no_row = F.col("c_present").isNull()
    busy = is_fresh(status0, F.col(f"c_{age_col}"), as_of, stale_seconds)
    skip_corrupted = F.coalesce((status0 == CORRUPTED) & ~changed, F.lit(False))
    non_video = ~is_video_like(F.col("mime_type"), name)
    zero = size <= 0
    skip_db = skip_from_catalog(
        status=status, stored_key=F.col("c_object_key"), stored_checksum=F.col("c_checksum"),
        incoming_checksum=F.col("md5"), canonical_key=canon, object_exists=exists,
        object_checksum=F.col("o_checksum"), object_checksum_checked=exists,
        incoming_size=size, object_size=F.col("o_size"),
    )
    size_differs = exists & (F.coalesce(F.col("o_size"), F.lit(0)) != size)
    store_match = exists & ~size_differs & skip_from_store(F.col("o_checksum"), F.col("md5"))
    out_of_attempts = F.coalesce(F.col("c_attempt_count"), F.lit(0)) >= max_attempts

    action = (F.when(no_row, "NO_ROW").when(busy, "BUSY").when(skip_corrupted, "SKIP_CORRUPTED")
              .when(non_video, "NON_VIDEO").when(zero, "ZERO").when(skip_db, "SKIP_DB")
              .when(store_match & (status != UPLOADED), "RECONCILE").when(store_match, "SKIP_STORE")
              .when(out_of_attempts, "MAX_ATTEMPTS").otherwise("TRANSFER"))
    reason = (F.when(size_differs, "size").when(exists, "checksum")
              .when(status == UPLOADED, "missing").otherwise("new"))

    return j.select(
        "source_name", "file_id", name.alias("file_name"), F.col("md5").alias("checksum"),
        size.alias("size"), canon.alias("object_key"), status.alias("status"), action.alias("action"),
        F.when(action.isin("TRANSFER", "MAX_ATTEMPTS"), reason).alias("reason"),
        F.col("c_id").alias("id"), F.col("c_attempt_count").alias("attempt_count"),
        F.col("o_size").alias("object_size"),
        *([busy.alias("is_fresh"), F.coalesce(changed, F.lit(False)).alias("checksum_changed"),
           skip_db.alias("skip_from_catalog"), skip_from_store(F.col("o_checksum"), F.col("md5")).alias("skip_from_store"),
           (~out_of_attempts).alias("attempts_left")] if with_flags else []),
    )


def discover(listing: DataFrame, catalog: DataFrame, config: DataFrame | None = None, *, as_of,
             sources: list[str] | None = None, order_col: str | None = None,
             max_id: Column | int | None = None) -> tuple[DataFrame, DataFrame]:
    """K-02: one sync of the given sources (all when ``sources`` is None).

    Returns (next catalog, work list). The upsert keeps unlisted rows, and a changed
    UPLOADED/CORRUPTED file is re-queued against its pre-upsert checksum (T1). Every listed
    file is on the work list: re-listing is what retries FAILED files.
    """
    from tidemark.operators.catalog import upsert_discovered

    lst = listing if sources is None else listing.where(F.col("source_name").isin(list(sources)))
    nxt = upsert_discovered(catalog, lst, config, as_of=as_of, order_col=order_col, requeue=True, max_id=max_id)
    work = lst.select(*FILE_KEY).distinct()
    return nxt, work


def verify_transfer(transfers: DataFrame, inventory_after: DataFrame) -> DataFrame:
    """K-03: after copying, the stored size must equal the planned size; otherwise the file
    fails with ``upload truncated: ..`` (a missing object counts as size 0).

    ``transfers``: plan rows (``source_name, file_id, checksum, size, object_key``). Returns
    outcomes for ``apply_outcomes``.
    """
    inv = inventory_after.select(F.col("object_key").alias("_k"), F.col("object_size").alias("_stored"))
    j = transfers.join(inv, F.col("object_key") == F.col("_k"), "left")
    actual = F.coalesce(F.col("_stored"), F.lit(0)).cast("bigint")
    ok = actual == F.col("size")
    return j.select(*FILE_KEY, F.when(ok, "ok").otherwise("failed").alias("outcome"), "checksum", "size",
                    "object_key", F.when(~ok, truncated_message(actual, F.col("size"))).alias("message"))
