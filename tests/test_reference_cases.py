"""The rules of SURVEY section 2 on rows of our own, through the Column functions."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.checksums import meta_checksum, meta_file_id, skip_from_store
from tidemark.functions.mime import is_video_like
from tidemark.functions.paths import object_key, sanitize_file_name
from tidemark.functions.predicates import skip_from_catalog
from tidemark.operators.setops import config_diff

KEY = "north/77_take.mov"
SKIP = {"status": "UPLOADED", "stored_key": KEY, "stored_checksum": "5F0C", "incoming": "5f0c", "canonical": KEY,
        "present": True, "object_checksum": None, "checked": False, "in_size": None, "object_size": None}
SKIP_SCHEMA = ("status string, stored_key string, stored_checksum string, incoming string, canonical string, present boolean, "
               "object_checksum string, checked boolean, in_size bigint, object_size bigint")


def values(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


@pytest.mark.parametrize(("change", "skipped"), [
    ({}, True),                                                     # checksums are compared without case
    ({"incoming": "5f0d"}, False),
    ({"status": "FAILED"}, False),
    ({"stored_key": "north/78_take.mov"}, False),
    ({"object_checksum": "77aa"}, False),                           # the stored object is another one
    ({"present": False}, False),
    ({"checked": True}, False),                                     # looked at, but it has no checksum
    ({"checked": True, "object_checksum": "5f0C"}, True),
    ({"object_checksum": "5f0c", "in_size": 4096, "object_size": 4095}, False),
    ({"object_checksum": "5f0c", "in_size": 4096, "object_size": 4096}, True),
])
def test_skip_from_catalog(spark, change, skipped):
    row = SKIP | change
    assert values(spark, skip_from_catalog(*map(F.col, SKIP)), SKIP_SCHEMA, [tuple(row.values())]) == [skipped]


def test_skip_from_store_needs_both_checksums(spark):
    rows = [("9e1", "9E1"), ("9e1", "9e2"), (None, "9e1"), ("9e1", None), (None, None)]
    assert values(spark, skip_from_store("o", "i"), "o string, i string", rows) == [True, False, False, False, False]


def test_object_metadata_keys_ignore_case(spark):
    maps = [({"x-AMZ-meta-CHECKSUM": "c1", "x-amz-meta-drive-file-ID": "i1"},), ({"Checksum": "c2"},), ({"etag": "e"},), (None,)]
    df = spark.createDataFrame(maps, "m map<string,string>")
    assert [tuple(r) for r in df.select(meta_checksum("m"), meta_file_id("m")).collect()] == \
        [("c1", "i1"), ("c2", None), (None, None), (None, None)]


def test_object_keys(spark):
    rows = [("north", "77", "take.mov", None), ("south", "a-1", "x y.mkv", "films/South"), ("south", "a-1", "p/q.mkv", "films/South")]
    assert values(spark, object_key("s", "f", "n", "p"), "s string, f string, n string, p string", rows) == \
        ["north/77_take.mov", "films/South/a-1_x y.mkv", "films/South/a-1_p_q.mkv"]


def test_names_lose_separators_and_control_characters(spark):
    rows = [("p\\q\\\\r.mov",), ("/p//q",), ("\x02 m\x1fn.mov \x7f",), (" \t ",), (None,)]
    assert values(spark, sanitize_file_name("n"), "n string", rows) == ["p_q_r.mov", "_p_q", "mn.mov", "unnamed", "unnamed"]


def test_video_like_by_type_or_suffix(spark):
    rows = [("video/quicktime", "notes.txt"), (None, "take.H265"), ("application/octet-stream", "a.b.h265"), ("text/plain", "h265"),
            ("image/png", None), ("", "")]
    assert values(spark, is_video_like("m", "n"), "m string, n string", rows) == [True, True, True, False, False, False]


def test_config_diff_names_both_sides(spark):
    schema = "source_name string, folder_id string"
    one = spark.createDataFrame([("north", "k1"), ("south", "k2"), ("west", "k3")], schema)
    two = spark.createDataFrame([("north", "k1"), ("south", "k9"), ("east", "k4")], schema)
    assert config_diff(one, one).count() == 0
    assert sorted((r.source_name, r.side) for r in config_diff(one, two).collect()) == \
        [("east", "only_in_b"), ("south", "only_in_a"), ("south", "only_in_b"), ("west", "only_in_a")]
