"""License scans by the Dice coefficient over word bigrams (operator 6).

Templates are normalised to words and kept as sets of word bigrams. A document is scanned for
bigrams of any template at once; only runs of such hits are looked at closer. A window of bigrams
W matches a template T when 2 |W & T| / (|W| + |T|) reaches the threshold t. That needs at least
t |T| / (2 - t) common bigrams and a window between t |T| / (2 - t) and (2 - t) |T| / t bigrams
long, so templates with too few hits in reach are pruned by counting alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._common import U64, arrow_map, rolling, string_buffers, table, text_slices, word_hashes

THRESHOLD = 0.8
#: Normalised words: runs of digits, letters and everything beyond ASCII, A-Z lower-cased.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[:128] = [not chr(c).isalnum() for c in range(128)]

#: Notices and characteristic passages of public licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
        "a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "This work is licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "creativecommons.org/publicdomain/zero/1.0/",
        "Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of "
        "Affirmer's Copyright and Related Rights and associated claims and causes of action",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0/",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION "
        "OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "EPL-1.0": [
        "Licensed under the Eclipse Public License 1.0.",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
}
#: The families below are written out from their names: (name, words of the name, version).
_GNU = [("LGPL-3.0", "Lesser", "3", "program"), ("LGPL-2.1", "Lesser", "2.1", "library"), ("AGPL-3.0", "Affero", "3", "program")]
_CC = [("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
       ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
for _name, _kind, _version, _thing in _GNU:
    _sep = ":" if _thing == "program" else ";"
    TEMPLATES[_name] = [
        f"This {_thing} is free software{_sep} you can redistribute it and/or modify it under the terms of the GNU {_kind} General "
        f"Public License as published by the Free Software Foundation, either version {_version} of the License, or (at your option) "
        "any later version.",
        f"You should have received a copy of the GNU {_kind} General Public License along with this {_thing}. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ]
for _code, _words in _CC:
    TEMPLATES[f"CC-{_code}-4.0"] = [
        f"Licensed under CC {_code} 4.0.",
        f"This work is licensed under a Creative Commons {_words} 4.0 International License.",
        f"creativecommons.org/licenses/{_code}/4.0/",
        "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
        f"Creative Commons {_words} 4.0 International Public License (\"Public License\").",
    ]
TEMPLATES["GPL-3.0"] += [
    "You should have received a copy of the GNU General Public License along with this program. If not, see "
    "<https://www.gnu.org/licenses/>.",
]
TEMPLATES["BSD"] += [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.",
]
TEMPLATES["MIT"] += [
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
]
#: Sentences that differ from another licence's by a word or a version: each is like its siblings at
#: the threshold, so only the best-scoring name tells them apart.
SIBLINGS = {
    name: [f"This work is licensed under the GNU {words}General Public License, version {version}.",
           f"Licensed under the GNU {words}General Public License, version {version}."]
    for name, words, version in [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"),
                                 ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]
}
for _code, _words in _CC:
    for _version, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported")):
        _older = _words.replace("NoDerivatives", "NoDerivs")
        SIBLINGS[f"CC-{_code}-{_version}"] = [
            f"Licensed under CC {_code} {_version}.",
            f"This work is licensed under a Creative Commons {_older} {_version} {_port} License.",
            f"creativecommons.org/licenses/{_code}/{_version}/",
        ]


def _bigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, bigram that starts at it, whether it stays inside its text)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return _bigrams_of(data, np.cumsum([0, *map(len, raw)]))


def _bigrams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, _, _, h = word_hashes(data, offsets, _SEPARATOR, lower=True)
    grams = rolling(h, 2)
    return rows, grams, rows[:-1] == rows[1:] if len(rows) > 1 else np.zeros(0, bool)


class Matcher:
    """Templates as bigram sets, and the search for windows like them."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.names = [name for name, texts in templates.items() for _ in texts]
        rows, grams, inside = _bigrams([t for texts in templates.values() for t in texts])
        self.sets = [np.unique(grams[inside & (rows[:-1] == k)]) for k in range(len(self.names))]
        self.all = np.unique(np.concatenate([*self.sets, np.zeros(0, U64)]))
        #: Which grams of ``all`` each template holds.
        self.member = np.array([np.isin(self.all, own) for own in self.sets], dtype=bool).reshape(len(self.sets), len(self.all))

    def hits(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.all):
            return np.zeros(len(grams), bool)
        return self.all[np.minimum(np.searchsorted(self.all, grams), len(self.all) - 1)] == grams

    def match(self, grams: np.ndarray, at: np.ndarray) -> list[tuple[int, int, str, float]]:
        """(first word, end word, name, Dice) of the best windows of one text; ``at`` holds its hits."""
        t = self.threshold
        windows: list[tuple[float, int, int, str]] = []
        own = self.member[:, np.searchsorted(self.all, grams[at])]
        counts = own.sum(axis=1)
        for k, name in enumerate(self.names):
            n = len(self.sets[k])
            least = int(np.ceil(t * n / (2 - t) - 1e-9))
            most = int((2 - t) * n / t + 1e-9)
            if not n or counts[k] < least:
                continue
            pos = at[own[k]]
            reach = np.searchsorted(pos, pos + most) - np.arange(len(pos))
            for first in np.flatnonzero(reach >= least).tolist():
                common, window = set(), set()
                last = int(pos[first])
                for e in pos[first:first + int(reach[first])].tolist():
                    window.update(grams[last:e + 1].tolist())
                    last = e + 1
                    common.add(int(grams[e]))
                    dice = 2 * len(common) / (len(window) + n)
                    if dice >= t:
                        windows.append((-dice, int(pos[first]), e + 2, name))
        found = []
        taken: set[int] = set()
        for dice, a, b, name in sorted(windows):
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                found.append((a, b, name, -dice))
        return sorted(found, key=lambda f: (f[0], f[2], f[1]))


def _scan(matcher: Matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            rows, grams, inside = _bigrams_of(*string_buffers(batch.column(1)))
            at = np.flatnonzero(inside & matcher.hits(grams)) if len(grams) else np.zeros(0, np.int64)
            own = rows[at] if len(at) else at
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for r in np.unique(own).tolist():
                a, b = np.searchsorted(rows, [r, r + 1])
                found[r] = matcher.match(grams[a:max(a, b - 1)], at[own == r] - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([",".join(sorted({x[2] for x in f})) for f in found], pa.string()),
                 pa.array([max((x[3] for x in f), default=0.0) for f in found], pa.float64()),
                 pa.array([",".join(f"{n}:{a}:{b}" for a, b, n, _ in f) for f in found], pa.string())],
                names=["doc_id", "n_matches", "licenses", "best_dice", "spans"])
    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: licences found, the best Dice and the word spans.

    Spans are name:first word:end word of normalised words. Null, empty and wordless texts match nothing; a template of fewer than two
    words has no bigrams and matches nothing. Among overlapping windows, of one licence or of
    several, the highest coefficient wins, then the earlier one. Rows are taken one by one, so null and
    repeated ids keep their own; texts are read whole; extra columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if templates is None:
        templates = {name: TEMPLATES.get(name, []) + SIBLINGS.get(name, []) for name in {**TEMPLATES, **SIBLINGS}}
    matcher = Matcher(templates, threshold)
    return arrow_map(docs.select("doc_id", "text"), _scan(matcher),
                     f"doc_id {kind}, n_matches long, licenses string, best_dice double, spans string")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
