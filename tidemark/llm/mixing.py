"""Mixing sources to target weights by pivotal rounding, with DataFrame functions only (operator 5).

Each source's target gives its documents an expected number of copies; the whole part is taken
as it is and the fraction is a mass of words between 0 and the document's size. Units are paired:
words move from one to the other, in a random direction that keeps every expectation, until one
of the two holds none or all of its words. Blocks of a source are folded this way into one
residual unit each, and the residuals meet in the blocks of the next level, down a tree, until
each source has one unit left; its words are taken in part. So a source's words are its target
to within one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm._common import table, written

#: Weight of the k-th source in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and most copies of a document.
SHARE, MOST = 1.5, 2
#: Units a block holds on average.
BLOCK = 200
#: Source rows are some 50 bytes each; more than this many are joined by a shuffle.
BROADCAST_SOURCES = 100_000
_UNIT = "struct<rank:bigint,doc_id:{id},text_hash:bigint,size:bigint,whole:bigint,mass:double>"


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_id, source_size, n, target): targets by weight, none above MOST times its size.

    With the sources in order of size / weight, the first ones are the capped ones, and the level
    (words per weight) of the rest is the largest of (total - capped words) / weight left.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    # One row for each source: single-partition windows over these are small.
    s = s.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("source_id") - 1) % len(WEIGHTS))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(every) * SHARE - before) / left)
    s = s.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(every)))
    return s.select("source", "source_id", "source_size", "n", "target")


def _pair(s: Column, x: Column) -> Column:
    """One step of the fold: the carried unit meets the next one, and one of the two is settled."""
    a = s["carry"]

    def with_mass(u: Column, mass: Column) -> Column:
        return F.struct(*[u[k].alias(k) for k in ("rank", "doc_id", "text_hash", "size", "whole")], mass.alias("mass"))

    gain = F.least(a["size"] - a["mass"], x["mass"])  # words that can go to the carried unit
    loss = F.least(a["mass"], x["size"] - x["mass"])  # words that can leave it
    chance = F.pmod(F.xxhash64(a["doc_id"], a["text_hash"], x["doc_id"], x["text_hash"]), F.lit(1 << 30)) / float(1 << 30)
    up = chance * (gain + loss) < loss
    a_full = a["size"] - a["mass"] <= x["mass"]
    a_empty = a["mass"] <= x["size"] - x["mass"]
    zero = F.lit(0.0)
    settled = (F.when(up & a_full, with_mass(a, a["size"].cast("double"))).when(up, with_mass(x, zero))
               .when(a_empty, with_mass(a, zero)).otherwise(with_mass(x, x["size"].cast("double"))))
    carried = (F.when(up & a_full, with_mass(x, x["mass"] - gain)).when(up, with_mass(a, a["mass"] + gain))
               .when(a_empty, with_mass(x, x["mass"] + loss)).otherwise(with_mass(a, a["mass"] - loss)))
    return F.struct(F.when(a.isNull(), x).otherwise(carried).alias("carry"),
                    F.when(a.isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(settled))).alias("out"))


def _fold(units: DataFrame, unit: str) -> DataFrame:
    """(source_id, block, carry, out): every block's settled units and the one that is left."""
    start = F.struct(F.lit(None).cast(unit).alias("carry"), F.array().cast(f"array<{unit}>").alias("out"))
    grouped = units.groupBy("source_id", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    return grouped.withColumn("s", F.aggregate("units", start, _pair)).select("source_id", "block", "s.carry", "s.out")


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, source, text, ...)``: size, source_size, target and taken.

    * Null, empty and blank texts have size 0 and are taken 0 times; a table without words has
      targets of 0. Null is a source of its own, the last one.
    * Repeated rows and null ids are units of their own; chance depends on the rows' contents
      only, so reruns and other partitionings give the same rows.
    * Ties of size are ordered by a hash of doc_id and text. Extra columns are not read.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
    sizes = written(rows, "sizes")
    unit = _UNIT.format(id=sizes.schema["doc_id"].dataType.simpleString())
    sources = written(source_targets(sizes), "sources").withColumnRenamed("source", "name")
    side = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    share = F.col("target") / F.greatest("source_size", F.lit(1))
    whole = F.least(F.floor(share), F.lit(MOST))
    placed = written(
        sizes.join(side, F.col("source").eqNullSafe(F.col("name")))
        .withColumn("whole", whole).withColumn("mass", F.least((share - whole) * F.col("size"), F.col("size").cast("double")))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash"), F.ceil(F.col("n") / BLOCK)))
        .select("source_id", "block", F.struct((-F.col("size")).alias("rank"), "doc_id", "text_hash", "size", "whole", "mass")
                .cast(unit).alias("unit")), "units")
    open_units = (F.col("unit.mass") > 0) & (F.col("unit.size") > 0)
    done = placed.where(~open_units).select("source_id", "unit")
    level = placed.where(open_units)
    blocks = int(sources.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 0)
    while blocks:
        folded = written(_fold(level, unit), "residuals")
        done = done.union(folded.select("source_id", F.explode("out").alias("unit")))
        level = folded.select("source_id", F.floor(F.col("block") / BLOCK).alias("block"), F.col("carry").alias("unit"))
        if blocks == 1:
            break
        blocks = -(-blocks // BLOCK)
    done = done.union(level.where("unit is not null").select("source_id", "unit"))
    taken = F.col("unit.whole") * F.col("unit.size") + F.round("unit.mass").cast("long")
    return done.join(side.drop("n"), "source_id").select(
        F.col("unit.doc_id").alias("doc_id"), F.col("unit.size").alias("size"), F.col("source_size"),
        F.col("target"), taken.cast("long").alias("taken"), F.col("name").alias("source"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents, as its contract states."""
    return mix_sources(table(spark, sf_dir, "documents"))
