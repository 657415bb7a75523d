"""Byte diagnostics by seeking: only the files on the work list are opened, and only their ranges."""

import hashlib
import os

import pytest

from tidemark.plans.integrity import BYTES_DIFFER, BYTES_MATCH, INCONCLUSIVE, MISSING_KEY, MISSING_OBJECT, SAMPLED_MATCH, diagnose_files

FILES = "k string, object_key string, source_size long, source_md5 string, meta_checksum string"
SIDE = "k string, path string, size long, base long"


def setup(spark, tmp_path, spec):
    """``spec``: key -> (object key, source bytes, stored bytes or None). Files are only made where
    the plan may open them: an unreadable stand-in is listed for all others."""
    files, source, store = [], [], []
    for k, (name, one, two) in spec.items():
        files.append((k, name, len(one), "A", None))
        equal = name and two is not None and len(one) == len(two)
        for side, data, rows in (("src", one, source), ("dst", two, store)):
            if data is None:
                continue
            path = str(tmp_path / side / k)
            if equal:
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as fh:
                    fh.write(b"pad" + data)
                os.utime(path, (1, 1))
            else:
                path = f"no-such-scheme://never/{k}"
            rows.append((k, path, len(data), 3))
    return (spark.createDataFrame(files, FILES), spark.createDataFrame(source, SIDE), spark.createDataFrame(store, SIDE))


BIG = bytes(range(256)) * 40
CASES = {
    "same": ("o", BIG, BIG), "differs": ("o", BIG, BIG[:-1] + b"!"), "between": ("o", BIG, BIG[:2000] + b"?" + BIG[2001:]),
    "empty": ("o", b"", b""), "missing": ("o", BIG, None), "size": ("o", BIG, BIG[:-1]), "no key": ("", BIG, BIG), "null key": (None, BIG, BIG),
}


@pytest.mark.parametrize("mode", ["chunks", "full"])
def test_files_missing_or_of_other_size_are_never_opened(spark, tmp_path, mode):
    report, ranges = diagnose_files(*setup(spark, tmp_path, CASES), key="k", mode=mode, chunk=64)
    got = {r.k: r for r in report.collect()}
    want = {"same": SAMPLED_MATCH, "differs": BYTES_DIFFER, "between": SAMPLED_MATCH, "empty": INCONCLUSIVE, "missing": MISSING_OBJECT,
            "size": BYTES_DIFFER, "no key": MISSING_KEY, "null key": MISSING_KEY}
    if mode == "full":
        want |= {"same": BYTES_MATCH, "between": BYTES_DIFFER, "empty": BYTES_MATCH}
    assert {k: r.verdict for k, r in got.items()} == want
    rows = ranges.collect()
    # A file of the other cases has no range at all: had one been opened, its scheme would be an error here.
    assert {r.k for r in rows} == {"same", "differs", "between"} | ({"empty"} if mode == "full" else set())
    assert all(r.source_error is None and r.store_error is None for r in rows)
    if mode == "chunks":
        assert (got["same"].n_ranges, got["differs"].ranges_matched) == (3, 2)
        mid = next(r for r in rows if r.k == "same" and r.name == "middle")
        assert mid.source_sha256 == hashlib.sha256(BIG[mid.offset:mid.offset + mid.length]).hexdigest()


def test_a_range_that_cannot_be_read_is_reported_and_inconclusive(spark, tmp_path):
    files, source, store = setup(spark, tmp_path, {"gone": ("o", BIG, BIG), "short": ("o", BIG, BIG), "fine": ("o", BIG, BIG)})
    os.remove(tmp_path / "dst" / "gone")
    os.truncate(tmp_path / "src" / "short", 500)
    report, ranges = diagnose_files(files, source, store, key="k", chunk=64)
    assert {r.k: r.verdict for r in report.collect()} == {"gone": INCONCLUSIVE, "short": INCONCLUSIVE, "fine": SAMPLED_MATCH}
    errors = {(r.k, r.name): (r.source_error or "", r.store_error or "") for r in ranges.collect()}
    assert errors["gone", "head"][1].startswith("FileNotFoundError") and errors["short", "tail"][0].startswith("EOFError")
    assert errors["short", "head"] == ("", "")


def test_tables_without_rows(spark, tmp_path):
    files, source, store = setup(spark, tmp_path, {"a": ("o", b"x", None)})
    report, ranges = diagnose_files(files.limit(0), source.limit(0), store.limit(0), key="k")
    assert report.collect() == [] and ranges.collect() == []
