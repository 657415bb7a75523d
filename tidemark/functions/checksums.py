"""Checksum and object-metadata expressions (P-01, P-02, P-03, F-04, F-06)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions._util import col

# Leading/trailing white space as a Python ``str.strip()`` sees it: Unicode white space plus
# the separators U+001C..U+001F. ``trim`` alone only removes the space character.
_EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Object user-metadata keys (compared lower-cased).
CHECKSUM_KEYS = ("x-amz-meta-checksum", "checksum")
FILE_ID_KEYS = ("x-amz-meta-drive_file_id", "x-amz-meta-drive-file-id", "drive_file_id")


def strip_ws(c: Column | str) -> Column:
    return F.regexp_replace(col(c), _EDGE_WS, "")


def normalize_checksum(c: Column | str) -> Column:
    """P-01: strip and lower-case; NULL stays NULL."""
    return F.lower(strip_ws(c))


def _first_meta_value(m: Column | str, keys: tuple[str, ...]) -> Column:
    hits = F.filter(F.map_entries(col(m)), lambda e: F.lower(e["key"]).isin(*keys))
    # get() returns NULL past the end; [0] would raise on an empty array under ANSI mode.
    return F.get(hits, 0)["value"]


def meta_checksum(m: Column | str) -> Column:
    """P-02: first metadata value whose key is a checksum key; NULL for NULL or empty maps."""
    return _first_meta_value(m, CHECKSUM_KEYS)


def meta_file_id(m: Column | str) -> Column:
    """P-03: first metadata value naming the source file id."""
    return _first_meta_value(m, FILE_ID_KEYS)


def checksum_changed(old: Column | str, new: Column | str) -> Column:
    """F-04: normalised checksums differ; two NULLs are equal. Never NULL."""
    return ~normalize_checksum(old).eqNullSafe(normalize_checksum(new))


def skip_from_store(object_checksum: Column | str, incoming_checksum: Column | str) -> Column:
    """F-06: both checksums non-empty and equal when normalised. Never NULL."""
    o, i = col(object_checksum), col(incoming_checksum)
    both = o.isNotNull() & (o != "") & i.isNotNull() & (i != "")
    return F.coalesce(both & (normalize_checksum(o) == normalize_checksum(i)), F.lit(False))
