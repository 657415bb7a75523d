"""File-name and object-key expressions (P-04, P-05, P-06, P-08, P-10)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions._util import col, lit
from tidemark.functions.checksums import strip_ws

MAX_NAME_CHARS = 200
MAX_EXT_CHARS = 16


def nfc(c: Column | str) -> Column:
    """Unicode NFC composition, JVM side (ICU4J ships with Spark); ASCII passes untouched."""
    c = col(c)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x00-\x7f]"), composed).otherwise(c)


def sanitize_file_name(name: Column | str, max_len: int = MAX_NAME_CHARS) -> Column:
    """P-04: NFC, drop NUL, runs of slashes/backslashes to ``_``, drop control characters,
    strip, empty to ``unnamed``, and cut to ``max_len`` keeping a short extension."""
    n = nfc(F.coalesce(col(name), F.lit("")))
    n = F.regexp_replace(n, "\u0000", "")
    n = F.regexp_replace(n, r"[\\/]+", "_")
    n = F.regexp_replace(n, r"[\x00-\x1f\x7f]", "")
    n = strip_ws(n)
    n = F.when(n == "", F.lit("unnamed")).otherwise(n)
    root = F.regexp_extract(n, r"(?s)^(.*)\.([^.]*)$", 1)
    ext = F.regexp_extract(n, r"(?s)^(.*)\.([^.]*)$", 2)
    keep = F.lit(max_len) - F.length(ext) - 1
    cut = (
        F.when(n.contains(".") & (F.length(ext) <= MAX_EXT_CHARS),
               F.concat(root.substr(F.lit(1), keep), F.lit("."), ext))
        .otherwise(n.substr(F.lit(1), F.lit(max_len)))
    )
    return F.when(F.length(n) > max_len, cut).otherwise(n)


def key_prefix(source_name: Column | str, object_prefix: Column | str | None = None) -> Column:
    """The key prefix: ``object_prefix`` when not NULL, else the source name, stripped of
    blanks and then of slashes."""
    p = col(source_name) if object_prefix is None else F.coalesce(col(object_prefix), col(source_name))
    return F.regexp_replace(strip_ws(p), r"^/+|/+$", "")


def object_key(source_name: Column | str, file_id: Column | str, file_name: Column | str,
               object_prefix: Column | str | None = None) -> Column:
    """P-05: ``prefix/fileid_safename``."""
    return F.concat(key_prefix(source_name, object_prefix), F.lit("/"), col(file_id), F.lit("_"),
                    sanitize_file_name(file_name))


def bucket_key(key: Column | str) -> Column:
    """P-06: drop leading slashes."""
    return F.regexp_replace(col(key), r"^/+", "")


def key_basename(key: Column | str) -> Column:
    """P-08: last path part of a key."""
    return F.substring_index(col(key), "/", -1)


def expected_key(stored_key: Column | str, built_key: Column | str) -> Column:
    """P-10: the stored key when non-empty, else the built key."""
    return F.coalesce(F.nullif(col(stored_key), lit("")), col(built_key))
