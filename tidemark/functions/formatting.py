"""Human-readable reasons (P-19). Integers get thousands separators, floats one digit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions._util import col


def thousands(c: Column | str) -> Column:
    return F.format_number(col(c).cast("bigint"), 0)


def truncated_message(actual: Column | str, expected: Column | str) -> Column:
    a, e = col(actual).cast("bigint"), col(expected).cast("bigint")
    return F.concat(F.lit("upload truncated: store="), thousands(a), F.lit(" != source="), thousands(e),
                    F.lit(" (lost "), thousands(e - a), F.lit(" bytes)"))


def too_small_message(size: Column | str, min_size: int) -> Column:
    return F.concat(F.lit("file too small: "), thousands(size), F.lit(f" B < {min_size:,} B"))


def duration_message(duration: Column | str, min_duration: float) -> Column:
    return F.concat(F.lit("duration too short: "), F.format_string("%.1f", col(duration)),
                    F.lit(f"s < {min_duration}s"))


def variance_message(rel: Column | str, variance: Column | str, min_variance: Column | str) -> Column:
    return F.concat(
        F.lit("frame variance too low at "), F.format_string("%.0f", col(rel) * 100), F.lit("%: "),
        F.format_string("%.1f", col(variance)), F.lit(" < "), F.format_string("%.1f", col(min_variance)),
        F.lit(" (green / gray / black frame)"),
    )
