"""Quality rules by repetition coverage (operator 12).

Words and lines of a batch of texts are hashed at once. For each n-gram length a rolling hash
stands for every run of n words of one text; runs met twice or more in their text are marked,
and the characters of all words under a mark are the coverage of that length. Only runs whose
shorter runs were all marked can be marked themselves, so longer lengths look at the few places
that the shorter ones left. Lines are hashed whole; characters in later copies of a line count.
A text fails if too large a share of its characters lies in repeats.

Work is one pass of numpy over Arrow batches: no shuffle, memory bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._common import (SPACE, U64, arrow_map, mix, rolling, string_buffers, table, text_slices,
                                  word_hashes)

#: Least number of words, and the largest percentage of words in repeated 3-word windows.
LEAST_WORDS, BASE_WORDS, BASE_PERCENT = 50, 3, 50
#: Fixed values from the published rules on repetition: percent of characters allowed inside
#: repeated runs by number of words, inside repeated lines, and percent of lines allowed to repeat.
COVERAGE = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_CHARS, LINES = 20, 30
#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_C = U64(0xD1342543DE82EF95)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars",
          *(f"repeat_chars_{n}" for n in COVERAGE)]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def repeated_runs(hashes: np.ndarray, rows: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
    """Those of the word ``places`` at which a run of n words of one text starts that the text
    holds twice or more."""
    places = places[places + n <= len(hashes)]
    places = places[rows[places] == rows[places + n - 1]]
    return places[repeated(mix(rolling(hashes, n)[places] + rows[places].astype(U64) * _C))] if len(places) else places


def under(places: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words covered by runs of n words that start at ``places``."""
    step = np.zeros(words + 1, dtype=np.int64)
    step[places] += 1
    np.subtract.at(step, places + n, 1)
    return np.cumsum(step[:-1]) > 0


def later_copies(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which items repeat an earlier one of the same row."""
    keys = mix(hashes + rows.astype(U64) * _C)
    first = np.unique(keys, return_index=True)[1]
    later = np.ones(len(keys), dtype=bool)
    later[first] = False
    return later


def repetition_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The columns ``COUNTS`` for texts held back to back in ``data``."""
    docs = len(offsets) - 1
    rows, starts, ends, hashes = word_hashes(data, offsets)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])        # code points before a byte
    chars = points[ends] - points[starts]

    def by_doc(weight: np.ndarray, of: np.ndarray = rows) -> np.ndarray:
        return np.bincount(of, weights=weight, minlength=docs).astype(np.int64)

    out = {"n_words": np.bincount(rows, minlength=docs).astype(np.int64), "word_chars": by_doc(chars)}
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    line_row, line_start, line_end, line_hash = word_hashes(data, offsets, separator=_NEWLINE)
    spaces = np.concatenate([[0], np.cumsum(SPACE[data])])
    full = spaces[line_end] - spaces[line_start] < line_end - line_start
    line_row, line_start, line_end, line_hash = (x[full] for x in (line_row, line_start, line_end, line_hash))
    copy = later_copies(line_hash, line_row)
    word_points = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])])
    inside = word_points[line_end] - word_points[line_start]
    out["n_lines"] = np.bincount(line_row, minlength=docs).astype(np.int64)
    out["n_dup_lines"] = by_doc(copy, line_row)
    out["dup_line_chars"] = by_doc(copy * inside, line_row)

    before = BASE_WORDS
    at = repeated_runs(hashes, rows, before, np.arange(len(hashes)))
    out["n_repeat_words"] = by_doc(under(at, before, len(hashes)))
    for n in COVERAGE:
        marked = np.zeros(len(hashes) + n, dtype=bool)
        marked[at] = True
        for shift in range(1, n - before + 1):
            at = at[marked[at + shift]]
        at = repeated_runs(hashes, rows, n, at)
        before = n
        out[f"repeat_chars_{n}"] = by_doc(under(at, n, len(hashes)) * chars)
    return out


def verdict(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(base_failed, kept)`` from the counts."""
    failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > BASE_PERCENT * c["n_words"])
    good = (100 * c["n_dup_lines"] <= LINES * c["n_lines"]) & (100 * c["dup_line_chars"] <= LINE_CHARS * c["word_chars"])
    for n, percent in COVERAGE.items():
        good &= 100 * c[f"repeat_chars_{n}"] <= percent * c["word_chars"]
    return failed, ~failed & good


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        counts = repetition_counts(*string_buffers(batch.column(1)))
        failed, kept = verdict(counts)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[c]) for c in COUNTS), pa.array(failed), pa.array(kept)],
                                         names=["doc_id", *COUNTS, "base_failed", "kept"])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` with its repetition counts and verdict.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that
    equal an earlier line), n_repeat_words (words in 3-word windows met twice or more), n_lines
    (lines with a word), dup_line_chars, repeat_chars_5 to repeat_chars_10 (code points of words
    inside runs of so many words met twice or more), base_failed and kept.

    * Null, empty or blank text: all counts 0; below the least number of words, so it fails.
    * A text shorter than a run has no such run. Lines are compared with all their spaces.
    * Repeated rows and repeated or null doc_ids are judged one by one, each by itself.
    * A share equal to its limit passes. Extra columns are not read; no rows give no rows.
    """
    return arrow_map(docs.select("doc_id", "text"), _rules,
                     "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; judged where they lie, without a join."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, kept = verdict(repetition_counts(*string_buffers(batch.column(at))))
            yield batch.filter(pa.array(kept))
    return docs.mapInArrow(run, docs.schema)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all documents."""
    return quality_rules(table(spark, sf_dir, "documents"))


_LENGTHS = [BASE_WORDS, *COVERAGE]
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(list_transform(w, lambda x: length(x))) AS chars FROM d),
k AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
      FROM d, (SELECT unnest({_LENGTHS}) AS n) WHERE len(w) >= n),
r AS (SELECT doc_id, p, n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, s) AS c FROM k) WHERE c > 1),
u AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + n)) AS p FROM r),
c AS (SELECT u.doc_id, {", ".join(f"count(*) FILTER (n = {n}) AS words_{n}, coalesce(sum(p.chars) FILTER (n = {n}), 0) AS chars_{n}" for n in _LENGTHS)}
      FROM u JOIN p ON p.doc_id = u.doc_id AND p.p = u.p GROUP BY u.doc_id),
l AS (SELECT doc_id, x, y, {_WORDS.format("y")} AS v FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS y, generate_subscripts(string_split(t, chr(10)), 1) AS x FROM d)),
g AS (SELECT doc_id, length(array_to_string(v, '')) AS chars, row_number() OVER (PARTITION BY doc_id, y ORDER BY x) > 1 AS again FROM l WHERE len(v) > 0),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (again), 0) AS dup_line_chars FROM g GROUP BY doc_id),
o AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(words_{BASE_WORDS}, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars,
             {", ".join(f"CAST(coalesce(chars_{n}, 0) AS BIGINT) AS repeat_chars_{n}" for n in COVERAGE)}
      FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND 100 * n_dup_lines <= {LINES} * n_lines AND 100 * dup_line_chars <= {LINE_CHARS} * word_chars
       AND {" AND ".join(f"100 * repeat_chars_{n} <= {p} * word_chars" for n, p in COVERAGE.items())} AS kept
FROM f
"""
