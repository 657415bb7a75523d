"""Container probe output (P-13)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions._util import col

PROBE_SCHEMA = (
    "streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, width: STRING, "
    "height: STRING, duration: STRING>>, format STRUCT<duration: STRING>"
)


def parse_probe(probe_json: Column | str) -> Column:
    """``struct<probed, has_video, codec, width, height, duration_sec>`` from probe JSON.

    The first stream with ``codec_type = 'video'`` counts; codec defaults to ``unknown``,
    width and height to 0; duration is the container's, else the stream's, and a
    non-numeric value gives NULL. A NULL JSON stands for a failed probe.
    """
    p = F.from_json(col(probe_json), PROBE_SCHEMA)
    video = F.get(F.filter(F.coalesce(p["streams"], F.array()), lambda s: s["codec_type"] == "video"), 0)

    def int_or_zero(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(0))

    raw_duration = F.coalesce(F.nullif(p["format"]["duration"], F.lit("")), F.nullif(video["duration"], F.lit("")))
    return F.struct(
        col(probe_json).isNotNull().alias("probed"),
        video.isNotNull().alias("has_video"),
        F.coalesce(video["codec_name"], F.lit("unknown")).alias("codec"),
        int_or_zero(video["width"]).alias("width"),
        int_or_zero(video["height"]).alias("height"),
        raw_duration.try_cast("double").alias("duration_sec"),
    )
