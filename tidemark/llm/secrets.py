"""Secret scans with DataFrame functions only (operator 9).

Three fixed patterns give the base spans. The method adds spans: in candidate strings (long runs
of key characters) a window of ``WINDOW`` characters slides along, its character counts are
updated by the one that enters and the one that leaves, and the largest Shannon entropy of a
window decides by character class. Base spans, which always stay, and words on the allow-list
(placeholders and UUIDs) are cut out of a candidate first, and what is left of it is tested piece by piece. Positions are code points: the pieces between the matches of a pattern
and the matches themselves alternate, so their lengths add up to offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm._common import table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy of a window in bits: (alphabet, bits) for strings of hexadecimal digits of one
#: case, and for all others. A random window reaches about 3.4 and 4.1.
CLASSES = {"hex": ("0123456789abcdefABCDEF", 3.0),
           "text": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.8)}
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh"
WORD = r"[A-Za-z0-9_-]+"
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
MASK = "[SECRET]"
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, ok=None, group: int = 0) -> Column:
    """Spans of the matches of ``pattern`` for which ``ok(match or its group)`` holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    told = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("found"), told.alias("told"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.length(x["gap"])
        b = a + F.length(x["found"])
        span = F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("end")))
        out = F.concat(s["out"], span)
        return F.struct(b.alias("at"), (F.when(ok(x["told"]), out).otherwise(s["out"]) if ok else out).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def window_entropy(string: Column, alphabet: str, width: int = WINDOW) -> Column:
    """Largest entropy in bits of ``width`` consecutive characters of ``string``, all in ``alphabet``.

    The state holds the counts of the window and the sum of c * log2(c) over them; each step
    changes the two counts of the characters that enter and leave.
    """
    part = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
                     F.lit(0).alias("at"), F.lit(0.0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        enters, leaves = x["enters"], F.coalesce(x["leaves"], F.lit(-1))
        counts = F.transform(s["counts"], lambda c, i: c + (i == enters).cast("int") - (i == leaves).cast("int"))
        c, d = F.get(s["counts"], enters), F.coalesce(F.get(s["counts"], x["leaves"]), F.lit(1))
        change = F.when(enters == leaves, 0.0).otherwise(
            F.get(part, c + 1) - F.get(part, c) + F.get(part, d - 1) - F.get(part, d))
        total = s["sum"] + change
        bits = F.when(s["at"] >= width - 1, F.lit(math.log2(width)) - total / width).otherwise(0.0)
        return F.struct(counts.alias("counts"), total.alias("sum"), (s["at"] + 1).alias("at"),
                        F.greatest(s["best"], bits).alias("best"))

    left = F.concat(F.array_repeat(F.lit(None).cast("int"), width), codes)
    pairs = F.zip_with(codes, F.slice(left, 1, F.size(codes)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    return F.aggregate(pairs, start, step)["best"]


def _secretive(string: Column) -> Column:
    """Entropy test of a piece by its character class."""
    one_case = string.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    mixed = string.rlike("[0-9]") & string.rlike("[A-Za-z]")
    bits = F.when(one_case, window_entropy(string, CLASSES["hex"][0]) >= CLASSES["hex"][1]).otherwise(
        window_entropy(string, CLASSES["text"][0]) >= CLASSES["text"][1])
    return F.when(mixed, bits).otherwise(False)


def base_spans(text: Column) -> Column:
    """Base spans of a text, sorted by start, then kind; null text is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(_spans(text, ASSIGN, 0, lambda value: F.length(value) >= 6, group=2),
                                 _spans(text, ACCESS, 1, lambda found: F.length(found) >= 20), _spans(text, HEX, 2)))


def _candidates(text: Column) -> Column:
    """Candidate strings with their places: array of (start, kind, end, found)."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return F.zip_with(_spans(text, CANDIDATE, 3), F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast("array<string>")),
                      lambda x, f: F.struct(x["start"].alias("start"), x["end"].alias("end"), f.alias("found")))


def _added(c: Column, base: Column) -> Column:
    """Spans that the method adds in one candidate: its pieces between base spans and allowed
    words, if ``WINDOW`` characters long and secretive."""
    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end"))

    taken = F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    words = _spans(c["found"], WORD, 3, lambda w: w.rlike(ALLOWED) | w.rlike(UUID))
    allowed = F.transform(words, lambda w: span(w["start"] + c["start"], w["end"] + c["start"]))
    cuts = F.array_sort(F.concat(taken, allowed, F.array(span(c["end"], c["end"]))))
    start = F.struct(c["start"].alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(s["out"], F.array(span(s["at"], x["start"])))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"),
                        F.when(x["start"] - s["at"] >= WINDOW, piece).otherwise(s["out"]).alias("out"))

    pieces = F.aggregate(cuts, start, step)["out"]
    return F.filter(pieces, lambda x: _secretive(F.substring(c["found"], x["start"] - c["start"] + 1, x["end"] - x["start"])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` rows with base_spans and all_spans (arrays of start, kind index, end).

    Added spans never overlap a base span: what a base span leaves of a candidate is tested by
    itself. Null and empty texts have no spans; rows are taken one by one, so repeated rows and
    null ids each keep their own; texts of any length are read whole, and extra columns pass
    through (these two names are replaced).
    """
    out = docs.drop("base_spans", "all_spans").withColumn("base_spans", base_spans(F.col("text")))
    added = F.flatten(F.transform(_candidates(F.col("text")), lambda c: _added(c, F.col("base_spans"))))
    return out.withColumn("all_spans", F.array_sort(F.concat("base_spans", added)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one); other rows as they are."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        piece = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask))
        return F.struct(F.when(x["start"] >= s["at"], piece).otherwise(s["out"]).alias("out"),
                        F.greatest(s["at"], x["end"]).alias("at"))

    done = F.aggregate("all_spans", start, step)
    clean = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    rows = scan_secrets(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"))
    text = F.when(F.size("all_spans") > 0, clean).otherwise(F.col("text"))
    columns = []
    for f in docs.schema.fields:
        value = F.col("row").getField(f.name)
        if f.name == "text":
            value = text
        elif f.name == "n_chars":
            value = F.when(F.size("all_spans") > 0, F.length(clean)).otherwise(value).cast(f.dataType)
        columns.append(value.alias(f.name))
    return rows.select(*columns)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents, as its contract states."""
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def counted(kind: int) -> Column:
        own = F.filter("base_spans", lambda x: x["kind"] == kind)
        return F.size(own).cast("long").alias(f"n_{KINDS[kind]}")

    count = [counted(k) for k in range(3)]
    return out.select("doc_id", *count, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
                      _joined(F.col("all_spans")).alias("spans"))
