"""Frames, boards and model runs as tables (D-03, D-04, D-06, D-07, D-10) and offset pages (D-09).

A board may hold a third of all rows: running sums go over partition borders
(``group_running``), medians touch only the rows of the bins around the middle, and the small
side of a join by board or clip is repeated per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemark.operators.joins import salt, salted
from tidemark.operators.ranking import group_running, stored

CENTER, LEAST_OFFSET = 240, 5
DIFFERENCE, FRAMES = 16, 2
#: Bins per natural logarithm of a value, so bins need no look at the smallest and largest value.
BINS = 256
MAX_PAGE_SIZE = 200


def _same(names: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{prefix}{n}"))
    return out


def stable_change(frames: DataFrame, cell: list[str], order: str, difference: str = "difference",
                  threshold: float = DIFFERENCE, frames_needed: int = FRAMES) -> DataFrame:
    """D-07: one row per change, a longest run of at least ``frames_needed`` consecutive frames of
    a cell whose difference exceeds ``threshold``: ``first_frame``, ``last_frame``, ``n_frames``.

    Runs are islands between breaks: the running number of breaks names them, also where a run
    crosses partitions. A null difference is a break; ``order`` must not tie inside a cell.
    """
    hit = F.coalesce(F.col(difference) > threshold, F.lit(False))
    rows = frames.select(*cell, F.col(order).alias("_frame"), hit.alias("_hit"))
    runs = group_running(rows, cell, ["_frame"], {"_island": (~F.col("_hit")).cast("long")})
    out = runs.where("_hit").groupBy(*cell, "_island").agg(
        F.min("_frame").alias("first_frame"), F.max("_frame").alias("last_frame"), F.count(F.lit(1)).alias("n_frames"))
    return out.where(F.col("n_frames") >= frames_needed).drop("_island")


def grouped_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Exact median per group (mean of the two middle values), ``group..., n_values, median``.

    A histogram over bins that keep the order of values tells which bins hold the middle; only
    rows of these are read again, and equal values are counted before they are ordered. Nulls
    and NaN are left out; a group without values has no row.
    """
    v = F.col(value).cast("double")
    rows = df.select(*group, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.withColumn("_bin", F.floor(F.signum("_v") * F.log1p(F.abs("_v")) * BINS))
    counts = group_running(rows.groupBy(*group, "_bin").agg(F.count(F.lit(1)).alias("_n")), group, ["_bin"],
                           {"_upto": F.col("_n")})
    size = counts.groupBy(*group).agg(F.max("_upto").alias("n_values"))
    size = size.select(*[F.col(g).alias(f"_s_{g}") for g in group], "n_values")
    low, high = F.floor((F.col("n_values") + 1) / 2), F.floor(F.col("n_values") / 2) + 1
    bins = counts.join(size, _same(group, "_s_")).where((F.col("_upto") >= low) & (F.col("_upto") - F.col("_n") < high))
    bins = salted(bins.select(*[F.col(g).alias(f"_b_{g}") for g in group], F.col("_bin").alias("_b"), "n_values",
                              (F.col("_upto") - F.col("_n")).alias("_before")))
    inside = rows.withColumn("_part", salt("_v")).join(
        bins, _same(group, "_b_") & (F.col("_bin") == F.col("_b")) & (F.col("_part") == F.col("_salt")))
    values = inside.groupBy(*group, "_bin", "_v", "_before", "n_values").agg(F.count(F.lit(1)).alias("_n"))
    ranked = group_running(values, [*group, "_bin"], ["_v"], {"_upto": F.col("_n")})
    first, last = F.col("_before") + F.col("_upto") - F.col("_n") + 1, F.col("_before") + F.col("_upto")
    middle = ranked.where((first <= high) & (last >= low))
    return middle.groupBy(*group).agg(F.max("n_values").alias("n_values"),
                                      ((F.min("_v") + F.max("_v")) / 2).alias("median"))


def grid_offset(points: DataFrame, board: list[str], center: float = CENTER, least: float = LEAST_OFFSET) -> DataFrame:
    """D-04: per board the offsets ``center - median(x)`` and ``center - median(y)``; a correction
    ``dx, dy`` is given only where an offset exceeds ``least`` pixels, else 0."""
    out = None
    for axis in ("x", "y"):
        m = grouped_median(points, board, axis)
        m = m.select(*board, (F.lit(float(center)) - F.col("median")).alias(f"offset_{axis}"))
        if out is None:
            out = m
        else:
            right = m.select(*[F.col(b).alias(f"_r_{b}") for b in board], f"offset_{axis}")
            out = out.join(right, _same(board, "_r_"), "full_outer").select(
                *[F.coalesce(b, f"_r_{b}").alias(b) for b in board], "offset_x", "offset_y")
    return out.select("*", *[F.when(F.abs(f"offset_{a}") > least, F.col(f"offset_{a}")).otherwise(0.0).alias(f"d{a}")
                             for a in ("x", "y")])


def merge_predictions(primary: DataFrame, fallback: DataFrame, cell: list[str], least: float = 0.5) -> DataFrame:
    """D-03: ``cell..., value, confidence, predictor`` from two predictors ``(cell..., value, confidence)``.

    The primary wins with a confidence of ``least`` or more; else the fallback, where it says
    anything; else the primary after all. A null confidence is below every other, a null value is
    no prediction, and of several predictions of one predictor for a cell the most confident
    counts (ties: the smallest value).
    """
    def best(df: DataFrame, prefix: str) -> DataFrame:
        rank = F.struct(F.col("confidence").isNotNull(), F.col("confidence"))
        rows = df.where(F.col("value").isNotNull()).groupBy(*cell, "value").agg(F.max(rank).alias("_r"))
        # Partial aggregates, so a cell with very many predictions is no task of its own.
        top = rows.groupBy(*cell).agg(F.min_by("value", F.struct(
            ~F.col("_r.col1"), -F.coalesce(F.col("_r.confidence"), F.lit(0.0)), F.col("value"))).alias(f"{prefix}value"),
            F.max("_r").alias("_m"))
        return top.select(*[F.col(c).alias(f"{prefix}{c}") for c in cell], f"{prefix}value",
                          F.col("_m.confidence").alias(f"{prefix}confidence"))
    a, b = best(primary, "_a_"), best(fallback, "_b_")
    same = F.lit(True)
    for c in cell:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    j = a.join(b, same, "full_outer")
    own = F.coalesce(F.col("_a_confidence") >= least, F.lit(False)) | F.col("_b_value").isNull()

    def pick(name: str, out: str) -> Column:
        return F.when(own, F.col(f"_a_{name}")).otherwise(F.col(f"_b_{name}")).alias(out)
    return j.select(*[pick(c, c) for c in cell], pick("value", "value"), pick("confidence", "confidence"),
                    F.when(own, "primary").otherwise("fallback").alias("predictor"))


def setting_key(params: str | Column) -> Column:
    """One text per parameter map whatever the order of its entries: ``key=value`` by key, joined
    by ``;``, with ``\\``, ``=`` and ``;`` escaped; a null value leaves the key alone."""
    def escaped(c: Column) -> Column:
        return F.regexp_replace(c.cast("string"), r"([\\=;])", r"\\$1")
    p = F.col(params) if isinstance(params, str) else params
    pairs = F.array_sort(F.map_entries(p))
    return F.array_join(F.transform(pairs, lambda e: F.concat(
        escaped(e["key"]), F.coalesce(F.concat(F.lit("="), escaped(e["value"])), F.lit("")))), ";")


def sweep_leaderboard(runs: DataFrame, params: str = "params", board: str = "board", score: str = "moves",
                      run: str = "run") -> DataFrame:
    """D-06: parameter settings ranked by their score, over all boards and per board.

    One pass over ``runs`` aggregates both granularities (grouping sets): ``scope`` (``total`` or
    ``board``), the board, the ``setting``, ``n_runs``, ``score``, and the best run (ties: the
    smallest). ``place`` skips after ties, ``dense_place`` does not; both count distinct scores,
    so a granularity with very many settings is ordered over all partitions.
    """
    rows = runs.select(setting_key(params).alias("setting"), F.col(board).alias("board"),
                       F.col(score).alias("_s"), F.col(run).alias("_run"))
    sums = rows.groupingSets([["setting"], ["setting", "board"]], "setting", "board").agg(
        F.when(F.grouping("board") == 1, "total").otherwise("board").alias("scope"),
        F.count(F.lit(1)).alias("n_runs"), F.sum("_s").alias("score"),
        F.min_by("_run", F.struct(-F.col("_s"), F.col("_run"))).alias("best_run"))
    sums = stored(sums.select("scope", "board", "setting", "n_runs", "score", "best_run"), "leaderboard")
    by = ["scope", "board"]
    scores = sums.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("_n"))
    ranked = group_running(scores, by, [F.col("score").desc()], {"_upto": F.col("_n"), "dense_place": F.lit(1)})
    places = ranked.select(*[F.col(c).alias(f"_p_{c}") for c in [*by, "score"]],
                           (F.col("_upto") - F.col("_n") + 1).alias("place"), F.col("dense_place").cast("long").alias("dense_place"))
    return sums.join(places, _same([*by, "score"], "_p_")).select(*sums.columns, "place", "dense_place")


def orient_board(frames: DataFrame, clip: str, order: str, cells: str = "cells", rank: int = 8) -> DataFrame:
    """D-10: ``frames`` with the cells of a clip reversed, and ``reversed``, when its first frame
    (smallest ``order``; it must not tie) has more upper-case than lower-case pieces among its
    first ``rank`` cells. Cells are an array of one-letter texts; null cells or clips stay as they are."""
    def pieces(pattern: str) -> Column:
        return F.size(F.filter(F.slice("_c", 1, rank), lambda x: x.rlike(pattern)))
    first = frames.where(F.col(clip).isNotNull()).groupBy(F.col(clip).alias("_clip")).agg(
        F.min_by(F.col(cells), F.col(order)).alias("_c"))
    turned = first.select("_clip", F.coalesce(pieces("^[A-Z]$") > pieces("^[a-z]$"), F.lit(False)).alias("_turn"))
    turned = salted(turned.where("_turn"))
    j = frames.withColumn("_part", salt(order)).join(
        turned, (F.col(clip) == F.col("_clip")) & (F.col("_part") == F.col("_salt")), "left")
    turn = F.coalesce("_turn", F.lit(False))
    return (j.withColumn(cells, F.when(turn, F.reverse(cells)).otherwise(F.col(cells))).withColumn("reversed", turn)
            .drop("_part", "_clip", "_salt", "_turn"))


def offset_page(df: DataFrame, order: list[Column], page: int, size: int, status: str | None = None
                ) -> tuple[DataFrame, Observation]:
    """D-09: page ``page`` (from 0) of ``size`` rows in ``order`` (a total order), and an Observation
    whose ``total`` is the number of matching rows once the page has been computed: both in one scan."""
    if page < 0 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must not be negative and size be within 1..{MAX_PAGE_SIZE}")
    seen = Observation()
    rows = df if status is None else df.where(F.col("status") == status)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(page * size).limit(size), seen


def page_with_total(df: DataFrame, order: list[Column], page: int, size: int, status: str | None = None) -> DataFrame:
    """D-09 computed: the rows of the page (at most ``MAX_PAGE_SIZE``) with ``total`` and ``has_next``."""
    rows, seen = offset_page(df, order, page, size, status)
    got = rows.collect()
    total = seen.get["total"]
    return df.sparkSession.createDataFrame(got, df.schema).withColumn("total", F.lit(total).cast("long")).withColumn(
        "has_next", F.lit((page + 1) * size < total))
