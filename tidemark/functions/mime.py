"""File type test (P-07)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions._util import col

# Accepted name suffixes and the folder-native video MIME type.
VIDEO_SUFFIXES = (".h265", ".hevc", ".265", ".mp4", ".mov", ".mkv", ".webm", ".m4v")
NATIVE_VIDEO_MIME = "application/vnd.google-apps.video"


def is_video_like(mime: Column | str, file_name: Column | str) -> Column:
    """MIME starts with ``video/`` or is the native video type, or the name has a video
    suffix; case-insensitive and NULL-safe (never NULL)."""
    m = F.lower(F.coalesce(col(mime), F.lit("")))
    n = F.lower(F.coalesce(col(file_name), F.lit("")))
    by_name = F.lit(False)
    for suffix in VIDEO_SUFFIXES:
        by_name = by_name | n.endswith(suffix)
    return m.startswith("video/") | (m == NATIVE_VIDEO_MIME) | by_name
