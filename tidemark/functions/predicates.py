"""Filters and predicates as total boolean Columns (F-01, F-02, F-03, F-05, F-09)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F

from tidemark.functions._util import col, lit
from tidemark.functions.checksums import normalize_checksum

# Catalog status codes.
NEW, PROCESSING, UPLOADED, FAILED, CORRUPTED = "NEW", "PROCESSING", "UPLOADED", "FAILED", "CORRUPTED"
STATUSES = (NEW, PROCESSING, UPLOADED, FAILED, CORRUPTED)
MAX_ATTEMPTS = 5
STALE_SECONDS = 3600


def as_time(v) -> Column:
    """A timestamp literal or Column (``as_of`` is always a parameter, never the clock)."""
    if isinstance(v, Column):
        return v
    if isinstance(v, _dt.datetime):
        return F.lit(v)
    return F.lit(v).cast("timestamp")


def file_filter(source_name: str | None = None, status: str | None = None,
                name_contains: str | None = None) -> Column:
    """F-01: optional equality filters and a case-insensitive "contains" on the name in
    which user ``%`` and ``_`` act as wildcards (they are not escaped)."""
    cond = F.lit(True)
    if source_name:
        cond = cond & (F.col("source_name") == source_name)
    if status:
        cond = cond & (F.col("status") == status)
    if name_contains:
        cond = cond & F.col("file_name").ilike(f"%{name_contains}%")
    return cond


def cursor_after(cursor_updated_at=None, cursor_id: int | None = None) -> Column:
    """F-02: keyset predicate for newest-first pages; TRUE unless both parts are given."""
    if cursor_updated_at is None or cursor_id is None:
        return F.lit(True)
    c = as_time(cursor_updated_at)
    return (F.col("updated_at") < c) | ((F.col("updated_at") == c) & (F.col("id") < lit(cursor_id)))


def is_fresh(status: Column | str, changed_at: Column | str, as_of, stale_seconds: int = STALE_SECONDS) -> Column:
    """F-03: PROCESSING and younger than the limit at ``as_of``."""
    age_ok = col(changed_at) > as_time(as_of) - F.make_dt_interval(secs=F.lit(stale_seconds))
    return F.coalesce((col(status) == PROCESSING) & age_ok, F.lit(False))


def attempts_left(attempt_count: Column | str, max_attempts: int = MAX_ATTEMPTS) -> Column:
    """F-09."""
    return F.coalesce(col(attempt_count) < max_attempts, F.lit(False))


def skip_from_catalog(status: Column, stored_key: Column, stored_checksum: Column,
                      incoming_checksum: Column, canonical_key: Column, object_exists: Column,
                      object_checksum: Column, object_checksum_checked: Column,
                      incoming_size: Column, object_size: Column) -> Column:
    """F-05: the seven-rule catalog skip test; FALSE at the first failing rule."""
    rules = [
        status == UPLOADED,
        F.coalesce(stored_key, F.lit("")) == canonical_key,
        object_exists,
        ~(incoming_size.isNotNull() & object_size.isNotNull() & (incoming_size != object_size)),
        ~(object_checksum_checked & incoming_checksum.isNotNull() & object_checksum.isNull()),
        ~(object_checksum.isNotNull() & incoming_checksum.isNotNull()
          & (normalize_checksum(object_checksum) != normalize_checksum(incoming_checksum))),
        normalize_checksum(stored_checksum).eqNullSafe(normalize_checksum(incoming_checksum)),
    ]
    out = F.lit(True)
    for r in rules:
        out = out & F.coalesce(r, F.lit(False))
    return out
