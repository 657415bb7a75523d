"""Media validation (size, probe, duration, frames) on records of our own, and A-06."""

import json

from pyspark.sql import functions as F

from tidemark.operators.integrity import pixel_stddev
from tidemark.plans.integrity import validate_media

GOOD = json.dumps({"format": {"duration": "71.25", "size": "9"}, "streams": [
    {"codec_type": "audio", "codec_name": "opus"},
    {"codec_type": "video", "codec_name": "av1", "width": 640, "height": 352}]})
MIB = 1 << 20


def _run(spark, files, probes, frames=None, **kw):
    f = spark.createDataFrame(files, "k bigint, file_size bigint")
    p = spark.createDataFrame(probes, "k bigint, probe_json string")
    fr = spark.createDataFrame(frames or [], "k bigint, rel_offset double, pixels array<double>")
    return {r.k: r for r in validate_media(f, p, fr, key="k", **kw).collect()}


def test_rejects_too_small_file(spark):
    r = _run(spark, [(1, 3 * MIB)], [(1, GOOD)])[1]
    assert r.ok is False and "too small" in r.reason and r.reason == "file too small: 3,145,728 B < 5,242,880 B"


def test_probe_failure_audio_only_and_short(spark):
    audio = json.dumps({"streams": [{"codec_type": "audio", "codec_name": "flac"}, {"codec_type": "data"}], "format": {"duration": "60"}})
    short = json.dumps({"streams": [{"codec_type": "video", "codec_name": "vp9"}], "format": {"duration": "2.5"}})
    out = _run(spark, [(1, 10 * MIB), (2, 10 * MIB), (3, 10 * MIB)], [(1, None), (2, audio), (3, short)])
    assert out[1].reason == "probe failed"
    assert out[2].reason == "probe: no video stream found"
    assert out[3].reason == "duration too short: 2.5s < 5.0s" and out[3].codec == "vp9"


def test_frames_low_variance_rejects_and_good_passes(spark):
    ramp = [float(i * 37 % 251) for i in range(3000)]
    solid = [131.0] * 3000
    frames = [(1, 0.0, ramp), (1, 0.33, solid), (2, 0.0, ramp), (2, 0.97, ramp)]
    out = _run(spark, [(1, 10 * MIB), (2, 10 * MIB), (3, 10 * MIB)], [(1, GOOD), (2, GOOD), (3, GOOD)], frames)
    assert out[1].ok is False and out[1].reason.startswith("frame variance too low at 33%: 0.0 < 8.0")
    assert out[2].ok is True and out[2].variance > 50
    assert out[3].ok is True and out[3].variance is None       # no samples: passes


def test_undecodable_sample_is_skipped(spark):
    frames = [(1, 0.0, None), (1, 0.33, [float(i * 37 % 251) for i in range(90)])]
    out = _run(spark, [(1, 10 * MIB)], [(1, GOOD)], frames)
    assert out[1].ok is True                                    # trap T4: the code's behaviour


def test_threshold_override_at_97_percent(spark):
    low = [40.0, 41.0] * 50                                     # std-dev 0.5
    mid = [90.0, 97.0] * 50                                     # std-dev 3.5
    out = _run(spark, [(1, 10 * MIB), (2, 10 * MIB)], [(1, GOOD), (2, GOOD)], [(1, 0.97, mid), (2, 0.97, low)])
    assert out[1].ok is True and out[2].ok is False


def test_pixel_stddev(spark):
    df = spark.createDataFrame([([float(i * 37 % 251) for i in range(3000)],), ([131.0] * 3000,), ([5.0],), (None,)],
                               "p array<double>")
    vals = [r[0] for r in df.select(pixel_stddev("p")).collect()]
    assert vals[0] > 50 and vals[1] < 5 and vals[2] == 0.0 and vals[3] is None
