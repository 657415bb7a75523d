"""Operator 6 against all windows of every text, and its defined edge cases."""

import re

from conftest import SF01
from tidemark.llm.license_scan import SIBLINGS, TEMPLATES, op6_license_scan, scan_licenses


def grams(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return list(zip(w, w[1:], strict=False))


def licences(text, templates, t=0.8):
    """Names with some window of bigrams at or above the threshold."""
    g = grams(text)
    out = set()
    for name, texts in templates.items():
        for own in map(set, map(grams, texts)):
            starts = [k for k, x in enumerate(g) if x in own]
            for a in starts:
                for b in starts:
                    if a <= b < a + (2 - t) * len(own) / t + 1:
                        w = set(g[a:b + 1])
                        if 2 * len(w & own) >= t * (len(w) + len(own)) - 1e-12:
                            out.add(name)
    return ",".join(sorted(out))


def test_whole_table_equals_all_windows(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = op6_license_scan(spark, SF01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.licenses == licences(texts[r.doc_id], TEMPLATES), r.doc_id
    assert {r.licenses for r in rows} >= {"", "MIT", "Apache-2.0"}


def test_edge_cases(spark):
    mit = TEMPLATES["MIT"][2]
    texts = [None, "", "!!", "MIT", "x " + mit.upper().replace(" ", "\n") + " y", mit.replace("Software", "Product"),
             "released under the mit license " * 50, "word " * 50_000 + "Licensed under the Apache License, Version 2.0.",
             "Released under the BSD", "été " + TEMPLATES["GPL-3.0"][0]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[4], "x"), (4, texts[4], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    out = scan_licenses(df).collect()
    assert len(out) == len(rows)
    for r, (_, t, _) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        assert r.licenses == licences(t, TEMPLATES)
    by = {r.doc_id: r for r in out}
    assert by[6].n_matches == 50 and by[4].spans.startswith("MIT:1:") and by[4].best_dice == 1.0
    assert by[9].spans == "GPL-3.0:1:13"
    assert scan_licenses(df.limit(0)).count() == 0
    assert scan_licenses(df, {"one": ["word"]}).where("n_matches > 0").count() == 0
    assert scan_licenses(df, {}).where("n_matches > 0").count() == 0


def test_families_are_told_apart(spark):
    texts = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC0 1.0.": "CC0-1.0",
        "licensed under cc by-nc-nd 3.0": "CC-BY-NC-ND-3.0", "Licensed under the Eclipse Public License 2.0.": "EPL-2.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "https://creativecommons.org/licenses/by-nd/4.0/": "CC-BY-ND-4.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        TEMPLATES["GPL-3.0"][1].replace("GNU General", "GNU Affero General"): "AGPL-3.0",
        TEMPLATES["GPL-3.0"][1].replace("GNU General", "GNU Lesser General"): "LGPL-3.0",
        "Released under the MIT License. Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0,MIT",
    }
    rows = [(i, f"Some words before. {t} And after it") for i, t in enumerate(texts)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == dict(enumerate(texts.values()))


def test_every_template_is_named_as_its_own(spark):
    given = [(name, t) for own in (TEMPLATES, SIBLINGS) for name, ts in own.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(given)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.best_dice) for r in scan_licenses(df).collect()}
    assert got == {i: (name, 1.0) for i, (name, _) in enumerate(given)}
