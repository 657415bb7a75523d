"""Spelling variants by bidirectional FM-indexes and search schemes (operator 11).

The vocabulary is counted by Spark. A word one edit away from a query equals it on one side of
the query's middle, so words meet where they share that exact half: every word is dealt, as a
text, under its possible left and right halves, and as a query under its own two. The halves are
dealt over shards by hash; a half that very many words share is dealt over several shards by
the words' own hash, and its queries go to all of those. No shard grows with the vocabulary.

Each shard holds the FM-index of its words, joined by delimiters, in both directions: suffix
ranks of the text and of its reverse, each with the rank of every symbol. A search extends to
the right or to the left and keeps the intervals of both in step. For a query cut in two the
schemes are: left half exactly, then to the right allowing one error, and right half exactly,
then to the left allowing one error; delimiters at both ends make hits whole words. All queries
of a shard advance together, one symbol a step, in numpy. What leaves a shard is one row per
query: how many words it found and the most frequent of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._common import rows_left, table, written

#: Letters of a word, and the code points that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point, by its checksum.
DELETE_EVERY = 97
#: Texts to a shard, on average, and symbols of queries searched together.
SHARD, TOGETHER = 50_000, 100_000
_BLOCK = 64
#: The symbol of the delimiter; letters follow.
_EDGE = 1


# ------------------------------------------------------------------ vocabulary

def vocabulary(docs: DataFrame, least_points: int = 5, least_count: int = 3) -> DataFrame:
    """``(word, n)``: the distinct words of all texts with their number of occurrences."""
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc"), run.alias("run"))
    h = F.crc32(F.concat(F.coalesce("doc", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    words = (runs.withColumn("h", h).withColumn("at", at)
             .select(F.when(F.col("h") % DELETE_EVERY == 0, cut).otherwise(F.col("run")).alias("word")))
    return (words.where(F.length("word") >= least_points).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


# ------------------------------------------------------------------ index

def suffix_ranks(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array by doubling; suffixes that agree on ``longest`` symbols stand by position."""
    rank = symbols.astype(np.int64)
    known = 1
    n = len(symbols)
    while True:
        later = np.zeros(n, dtype=np.int64)
        later[:max(n - known, 0)] = rank[known:] + 1
        key = rank * (int(rank.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        if known * 2 >= longest:
            return order
        s = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        known *= 2


class Ranks:
    """How many of the first i symbols of a transformed text are below c: counts at every block
    border plus a comparison inside one block. Symbol 0 ends the text."""

    def __init__(self, text: np.ndarray, order: np.ndarray, size: int):
        n = len(text)
        last = text[order - 1]
        blocks = n // _BLOCK + 1
        padded = np.full(blocks * _BLOCK, 255, dtype=np.uint8)
        padded[:n] = last
        self.last = padded
        self.blocks = padded.reshape(blocks, _BLOCK)
        per = np.zeros((blocks + 1, size + 1), dtype=np.int32)
        block_of = np.arange(n) // _BLOCK
        np.add.at(per, (block_of + 1, last.astype(np.int64) + 1), 1)
        self.below = np.cumsum(np.cumsum(per, axis=0, dtype=np.int32), axis=1, dtype=np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])    # suffixes that begin below a symbol

    def pair(self, i: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each (i, c): symbols below c, and symbols equal to c, among the first i."""
        b, rest = i // _BLOCK, i % _BLOCK
        inside = self.blocks[b]
        seen = np.arange(_BLOCK)[None, :] < rest[:, None]
        c = c.astype(np.int64)
        low = self.below[b, c] + ((inside < c[:, None]) & seen).sum(axis=1)
        same = self.below[b, c + 1] - self.below[b, c] + ((inside == c[:, None]) & seen).sum(axis=1)
        return low.astype(np.int64), same.astype(np.int64)


class BidirectionalIndex:
    """FM-index of ``#word#word...#`` and of its reverse, over a list of words."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype=np.uint32)
        self.alphabet, text = np.unique(points, return_inverse=True)
        text = (text + _EDGE).astype(np.uint8)
        backward = np.append(text[::-1], np.uint8(0))
        text = np.append(text, np.uint8(0))
        size = len(self.alphabet) + 1
        longest = max(map(len, words)) + 2
        self.order = suffix_ranks(text, longest)
        self.word_at = np.cumsum(text == _EDGE)                      # words begun up to a position
        self.left = Ranks(text, self.order, size)
        self.right = Ranks(backward, suffix_ranks(backward, longest), size)
        self.size = len(text)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of ``words`` in rows padded with delimiters, 255 for unknown ones, and lengths."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        code = np.where(self.alphabet[at] == points, at + _EDGE, 255).astype(np.uint8)
        out = np.full((len(words), int(lengths.max()) + 1), _EDGE, dtype=np.uint8)
        row = np.repeat(np.arange(len(words)), lengths)
        out[row, np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = code
        return out, lengths

    def extend(self, state: np.ndarray, c: np.ndarray, to_left: bool) -> np.ndarray:
        """States (low, low in the reverse, width) after one more symbol on one side."""
        here, there = (0, 1) if to_left else (1, 0)
        ranks = self.left if to_left else self.right
        known = c != 255
        c = np.where(known, c, _EDGE)
        low_a, same_a = ranks.pair(state[:, here], c)
        low_b, same_b = ranks.pair(state[:, here] + state[:, 2], c)
        out = np.empty_like(state)
        out[:, here] = ranks.first[c.astype(np.int64)] + same_a
        out[:, there] = state[:, there] + low_b - low_a
        out[:, 2] = np.where(known, same_b - same_a, 0)
        return out

    def branches(self, state: np.ndarray, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state number, letter) for every letter that may follow: read off short intervals, all letters
        for long ones."""
        letters = np.arange(_EDGE + 1, len(self.alphabet) + 1, dtype=np.uint8)
        low, width = state[:, 0 if to_left else 1], state[:, 2]
        short = np.flatnonzero(width <= len(letters))
        long = np.flatnonzero(width > len(letters))
        number = np.repeat(short, width[short])
        symbol = (self.left if to_left else self.right).last[np.repeat(low[short], width[short]) + _within(width[short])]
        pairs = np.unique(number * 256 + symbol)
        pairs = pairs[pairs % 256 > _EDGE]
        return (np.concatenate([pairs // 256, np.repeat(long, len(letters))]),
                np.concatenate([(pairs % 256).astype(np.uint8), np.tile(letters, len(long))]))

    def near(self, words: list[str], cuts: np.ndarray, exact_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, word number) one edit apart whose exact half is the one given.

        ``cuts`` is the length of each query's left half. The exact half with its delimiter is
        matched first, from its outer end inwards; then the other half and its delimiter are
        read outwards, each step also trying the one error. Pairs may repeat.
        """
        code, length = self.codes(words)
        q = np.arange(len(words))
        far = code.shape[1] - 1

        def symbol(of: np.ndarray, k: np.ndarray) -> np.ndarray:
            """The k-th symbol outwards from the outer end of the exact half; a delimiter at the end."""
            at = k if exact_left else length[of] - 1 - k
            inside = (at >= 0) & (at < length[of])
            return np.where(inside, code[of, np.clip(at, 0, far)], _EDGE)

        # The outer delimiter, then the exact half.
        state = np.tile(np.array([0, 0, self.size], dtype=np.int64), (len(words), 1))
        state = self.extend(state, np.full(len(words), _EDGE, np.uint8), not exact_left)
        half = cuts if exact_left else length - cuts
        for k in range(int(half.max(initial=0))):
            go = np.flatnonzero((half[q] > k) & (state[:, 2] > 0))
            state[go] = self.extend(state[go], symbol(q[go], np.full(len(go), k)), not exact_left)
        alive = state[:, 2] > 0
        state, q = state[alive], q[alive]
        k, wrong = half[q], np.zeros(len(q), dtype=bool)
        found = []
        while len(q):
            # Queries read to their closing delimiter with one error are hits.
            ends = k > length[q]
            done = np.flatnonzero(ends & wrong)
            if len(done):
                starts = np.repeat(state[done, 0], state[done, 2]) + _within(state[done, 2])
                number = self.word_at[self.order[starts]] - 1
                found.append((np.repeat(q[done], state[done, 2]), number))
            on = np.flatnonzero(~ends)
            state, q, k, wrong = state[on], q[on], k[on], wrong[on]
            if not len(q):
                break
            c = symbol(q, k)
            steps = [(self.extend(state, c, not exact_left), q, k + 1, wrong)]
            free = np.flatnonzero(~wrong)
            if len(free):
                inner = free[k[free] < length[q[free]]]
                # The query's symbol is missing in the word.
                steps.append((state[inner], q[inner], k[inner] + 1, np.ones(len(inner), dtype=bool)))
                # The word has one symbol more here, or another one in place of the query's.
                at, s = self.branches(state[free], not exact_left)
                many = free[at]
                wide = self.extend(state[many], s, not exact_left)
                steps.append((wide, q[many], k[many], np.ones(len(many), dtype=bool)))
                other = (k[many] < length[q[many]]) & (s != symbol(q[many], k[many]))
                steps.append((wide[other], q[many[other]], k[many[other]] + 1, np.ones(int(other.sum()), dtype=bool)))
            state, q, k, wrong = (np.concatenate(x) for x in zip(*steps, strict=True))
            keep = state[:, 2] > 0
            state, q, k, wrong = state[keep], q[keep], k[keep], wrong[keep]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of ``counts`` items."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


# ------------------------------------------------------------------ search

_GROUP = ["side", "home", "bucket", "part"]


def _halves(vocab: DataFrame, both_ways: bool) -> DataFrame:
    """Each word under halves of its own: its two as a query, or all that a query one edit away may have."""
    n = F.length("word")
    left = [F.floor((n + d) / 2).cast("int") for d in ((-1, 0, 1) if both_ways else (0,))]
    right = [F.floor((n + d) / 2).cast("int") for d in ((0, 1, 2) if both_ways else (1,))]
    halves = [F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), k).alias("half")) for k in left]
    halves += [F.struct(F.lit(1).alias("side"), F.substring("word", n - k + 1, k).alias("half")) for k in right]
    return vocab.select("word", "n", F.inline(F.array_distinct(F.array(*halves))))


def _place(halves: DataFrame, hot: DataFrame | None, shards: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("side", "half"), F.lit(shards))
    if hot is None:
        return halves.select("word", "n", "side", F.lit("").alias("home"), bucket.alias("bucket"), F.lit(None).cast("long").alias("parts"))
    return halves.join(hot, ["side", "half"], "left").select(
        "word", "n", "side", F.when(F.col("parts").isNotNull(), F.col("half")).otherwise("").alias("home"),
        F.when(F.col("parts").isNull(), bucket).otherwise(-1).alias("bucket"), "parts")


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of queries, shortest first, of about ``TOGETHER`` symbols with padding."""
    at = 0
    while at < len(lengths):
        to = at + 1
        while to < len(lengths) and (to + 1 - at) * (lengths[to] + 1) <= TOGETHER:
            to += 1
        yield at, to
        at = to


def _answers(index: BidirectionalIndex, texts: list[str], counts: np.ndarray, queries: list[str], side: int) -> pa.RecordBatch | None:
    """One row for each query that finds a word: how many, and the most frequent of them."""
    queries = sorted(queries, key=len)
    out = []
    for a, b in _blocks(np.array([len(w) for w in queries])):
        words = queries[a:b]
        cuts = np.array([len(w) // 2 for w in words], dtype=np.int64)
        q, t = index.near(words, cuts, exact_left=side == 0)
        q, t = np.divmod(np.unique(q * len(texts) + t), len(texts))
        if side == 1:       # both halves may do; such pairs belong to the other side
            first = np.array([texts[y][:cuts[x]] != words[x][:cuts[x]] for x, y in zip(q.tolist(), t.tolist(), strict=True)], dtype=bool)
            q, t = q[first], t[first]
        if not len(q):
            continue
        by = np.lexsort((t, -counts[t], q))
        q, t = q[by], t[by]
        who, at, many = np.unique(q, return_index=True, return_counts=True)
        out.append(pa.RecordBatch.from_arrays(
            [pa.array([words[x] for x in who]), pa.array(many.astype(np.int64)), pa.array([texts[y] for y in t[at]]), pa.array(counts[t[at]])],
            names=["word", "n_near", "form", "form_n"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive in order, the texts of each before its queries, which pass by in batches."""
    group, held, index, texts, counts = None, {}, None, [], None
    for batch in batches:
        columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
        keys = list(zip(*(columns[c] for c in _GROUP), strict=True))
        kinds, words, ns = columns["kind"], columns["word"], columns["n"]
        at = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[at] and kinds[i] == kinds[at]:
                continue
            if keys[at] != group:
                group, held, index = keys[at], {}, None
            if kinds[at] == 0:
                held.update(zip(words[at:i], ns[at:i], strict=True))
            elif held:
                if index is None:
                    texts = sorted(held)
                    counts = np.array([held[w] for w in texts], dtype=np.int64)
                    index = BidirectionalIndex(texts)
                found = _answers(index, texts, counts, words[at:i], group[0])
                if found is not None:
                    yield found
            at = i


def near_words(vocab: DataFrame) -> DataFrame:
    """``(word, n_near, form, form_n)`` for words of ``vocab(word, n)`` that have a word one edit
    away in it: how many, and the most frequent of them (ties: the smallest). Words are distinct.
    """
    texts = written(_halves(vocab, True), "halves")
    rows = texts.count()
    shards = max(1, -(-rows // SHARD))
    hot = None
    if rows > SHARD:
        many = F.count(F.lit(1))
        hot = written(texts.groupBy("side", "half").agg(many.alias("many")).where(F.col("many") > SHARD)
                      .select("side", "half", F.ceil(F.col("many") / SHARD).alias("parts")), "hot")
        hot = hot if rows_left(hot) else None
    dealt = _place(texts, hot, shards).select(
        *_GROUP[:3], F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("word"), F.col("parts"))).cast("long").alias("part"),
        F.lit(0).alias("kind"), "word", "n")
    asked = _place(_halves(vocab, False), hot, shards).select(
        *_GROUP[:3], F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0).cast("long")))).alias("part"),
        F.lit(1).alias("kind"), "word", "n")
    found = (dealt.union(asked).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "kind")
             .mapInArrow(_search, "word string, n_near long, form string, form_n long"))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n")))


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for ``links(word, form)`` without cycles: each round doubles the way followed."""
    at = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                          F.col("next").isNotNull().alias("moved")), "roots")
        moved = rows_left(at.where("moved"))
        at = at.select("word", "root")
        if not moved:
            return at


def spelling_variants(docs: DataFrame, ratio: int = 2, least_points: int = 5, least_count: int = 3) -> DataFrame:
    """One row per word of the vocabulary of ``docs(doc_id, text, ...)``, with the form it varies.

    Returns word, form (the most frequent word one edit away, ties to the smallest, if it is
    ``ratio`` times as frequent or more), root (the form's form and so on to the last; the word
    itself without a form), n, n_near (words one edit away), form_n (the form's n). Counts rise
    along forms, so there are no cycles.

    * Null and empty texts have no words; a null doc_id counts as an empty one in the checksum.
    * Repeated rows and repeated doc_ids count as often as they stand there.
    * Runs of any length are whole words; words below ``least_points`` or ``least_count`` are left out.
    * Extra columns are not read; a table without words gives no rows.
    """
    vocab = written(vocabulary(docs, least_points, least_count), "vocabulary")
    near = written(near_words(vocab), "near")
    out = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("form_n") >= ratio * F.col("n"), F.struct("form", "form_n")).alias("f")).select(
        "word", F.col("f.form").alias("form"), "n", "n_near", F.col("f.form_n").alias("form_n"))
    out = written(out, "forms")
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all documents, as its contract states."""
    return spelling_variants(table(spark, sf_dir, "documents"))


# One step of the checksum for each of the 256 byte values, from its polynomial.
_STEP = "list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, {})"
_BYTES = "list_transform(range(1, octet_length(b) + 1), lambda i: CAST('0x' || substr(hex(b), 2 * i - 1, 2) AS BIGINT))"
OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT list({_STEP.format("CAST(x AS BIGINT)")} ORDER BY x) AS s FROM range(0, 256) AS r(x)),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS c FROM o GROUP BY doc_id, run),
b AS (SELECT run, c, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS b FROM g),
h AS (SELECT run, c, xor(list_reduce({_BYTES}, lambda a, x: xor(a // 256, t.s[CAST(xor(a, x) % 256 AS BIGINT) + 1]), 4294967295), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % {DELETE_EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN v b ON a.less = b.word),
q AS (SELECT word, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.m >= 2 * v.n THEN q.other END AS form, CASE WHEN q.m >= 2 * v.n THEN q.m END AS form_n
      FROM v LEFT JOIN q ON q.word = v.word AND q.place = 1),
k AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT k.word, f.form, far + 1 FROM k JOIN f ON f.word = k.root WHERE f.form IS NOT NULL),
l AS (SELECT word, max_by(root, far) AS root FROM k GROUP BY word)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN l ON l.word = f.word
"""
