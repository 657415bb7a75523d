"""Benchmark decontamination with DataFrame functions only (operator 2).

Every benchmark item is cut into windows of ``WINDOW`` normalised words (a shorter item is one
window). Their 64-bit hashes are the probe set. The documents are scanned once: each word
position hashes the window that starts there and probes the set, and a hit counts only if the
words themselves are equal. The set is broadcast while it has at most ``BROADCAST_WINDOWS``
windows (counted first); a larger one is joined by a shuffle on the hash instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm._common import table, written

WINDOW = 10
#: About 100 bytes each, so at most 20 MB reach an executor.
BROADCAST_WINDOWS = 200_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """Words of digits, a-z and everything beyond ASCII, with A-Z lower-cased; null has none."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    parts = F.split(F.coalesce(low, F.lit("")), _SEPARATORS, -1)
    # Only the first and the last part can be empty.
    first = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(F.size(parts) - last - first + 1, F.lit(0)))


def _window(words: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(n)], F.lit(n))


def windows_of(items: DataFrame) -> DataFrame:
    """(item_id, n, gram, h): the distinct windows of each item."""
    words = items.select("item_id", normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW))
    at = words.select("item_id", "words", n.alias("n"),
                      F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))
    gram = at.select("item_id", "n", F.slice("words", F.col("at") + 1, F.col("n")).alias("g"))
    h = F.lit(None).cast("long")
    for k in range(1, WINDOW + 1):
        h = F.when(F.col("n") == k, _window(F.col("g"), F.lit(0), k)).otherwise(h)
    return gram.select("item_id", "n", F.array_join("g", " ").alias("gram"), h.alias("h")).distinct()


def scan(docs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of ``docs``: its words, and where windows of ``items`` occur.

    Returns ``keys``, n_words, hits (array of (at, n), one for each occurrence) and item_ids
    (of the items with an occurrence, sorted as strings). ``keys`` must tell the rows apart.
    """
    windows = written(windows_of(items), "windows")
    grams = windows.select("n", "gram", "h").distinct()
    lengths = sorted(r["n"] for r in grams.select("n").distinct().collect())  # at most WINDOW values
    probe = grams.select("h", "gram")
    if grams.count() <= BROADCAST_WINDOWS:
        probe = F.broadcast(probe)
    words = docs.select(*keys, normal_words(F.col("text")).alias("words"))
    size = F.size("words")
    # The position after the last word stays, hit or not: it brings every row to the result.
    at = words.select(*keys, "words", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    starts = [F.when(F.col("at") + n <= size, F.struct(F.lit(n).alias("n"), _window(F.col("words"), F.col("at"), n).alias("h")))
              for n in lengths]
    if len(starts) == 1:
        at = at.withColumn("w", starts[0])
    elif starts:
        at = at.withColumn("w", F.explode(F.array(*starts)))
    else:
        at = at.withColumn("w", F.lit(None).cast("struct<n:int,h:bigint>"))
    at = at.select(*keys, "words", "at", F.col("w.n").alias("n"), F.col("w.h").alias("wh"))
    same = F.array_join(F.slice(F.col("words"), F.col("at") + 1, F.col("n")), " ") == F.col("gram")
    found = at.join(probe, (F.col("wh") == F.col("h")) & same, "left").where(F.col("gram").isNotNull() | (F.col("at") == size))
    found = written(found.select(*keys, size.alias("n_words"), "at", F.when(F.col("gram").isNotNull(), F.col("n")).alias("n"),
                                 "gram").distinct(), "hits")
    spans = found.groupBy(*keys, "n_words").agg(
        F.sort_array(F.collect_list(F.when(F.col("gram").isNotNull(), F.struct("at", "n")))).alias("hits"))
    named = (found.where("gram is not null").select(*keys, "gram").distinct()
             .join(windows.select("gram", "item_id"), "gram").select(*keys, F.col("item_id").cast("string").alias("item_id")).distinct()
             .groupBy(*keys).agg(F.sort_array(F.collect_list("item_id")).alias("item_ids"),
                                 F.count(F.lit(1)).alias("n_items")))
    named = named.select(*[F.col(k).alias(f"_{k}") for k in keys], "item_ids", "n_items")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = spans.join(named, on, "left") if keys else spans
    return out.select(*keys, "n_words", "hits", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                      F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def covered(hits: Column) -> Column:
    """Number of words inside the union of the sorted (at, n) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    total = F.aggregate(hits, start, lambda s, x: F.struct(
        F.greatest(s["end"], x["at"] + x["n"]).alias("end"),
        (s["sum"] + F.greatest(x["at"] + x["n"] - F.greatest(s["end"], x["at"]), F.lit(0))).alias("sum")))
    return total["sum"]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)`` with the benchmark items found in it.

    Returns doc_id, n_words, n_hit (words inside an occurrence), n_items, item_ids, contaminated.

    * Null or empty text has no words; a null, empty or wordless item has no window.
    * Null and repeated doc_ids are told apart by row, so each row gets its own result.
    * Items that repeat an item_id are one item; equal items are all named. Null item_ids are
      scanned for but not named.
    * An empty table on either side gives no hits; extra columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return scan(rows, items.select("item_id", "text"), ["row", "doc_id"]).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("hits")).alias("n_hit"), "n_items",
        "item_ids", (F.size("hits") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of a benchmark item occurs, all columns kept.

    A decision belongs to (doc_id, text), so repeated rows share it and null ids are safe.
    """
    seen = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    hit = (scan(seen, items.select("item_id", "text"), ["doc_id", "text_hash"]).where(F.size("hits") > 0)
           .select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")))
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash")), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents against all benchmark items, as its contract states."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_DUCK_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_DUCK_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_DUCK_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM g),
q AS (SELECT doc_id, w, k.n, unnest(range(1, len(w) - k.n + 2)) AS p FROM d, k WHERE len(w) >= k.n),
h AS (SELECT q.doc_id, q.p, q.n, g.item_id FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram FROM q) q
      JOIN g ON q.n = g.n AND q.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
