"""Alignment of two tokenizers by inverted pair bitmaps (operator 13).

Each text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets at
which tokens of both end cut the text into groups, and the two tokens that end there are linked.

Neither vocabulary has a token that goes on past the single space between two printed
characters, so texts are cut there and every distinct stretch is encoded and aligned once per
batch of texts; a stretch whose tokens do not spell its bytes voids its text.

Documents are numbered inside chunks of at most 65,536. A chunk has, for every pair of ids it
links, a bitmap of its documents, merged from the batches: sorted 16-bit numbers, or plain bits
where those are shorter. Planes of further bitmaps hold how often a document links the pair
beyond once, one plane per binary digit. The first bitmap's ones are the pair's document count;
with the planes' ones at their weights they are its link count, and sums over chunks are counts
of the corpus. The best count of each B id is joined to its pairs, and the bitmaps lead the
scores back: each chunk adds up what its documents get. No task holds more than one chunk's sums.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._common import table, text_slices, written

FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Documents and bytes of text of a chunk, bytes of text read together, characters of stretches
#: encoded together, stretches remembered.
CHUNK_DOCS, CHUNK_BYTES, BATCH_BYTES, JOINED, REMEMBERED = 1 << 16, 16 << 20, 8 << 20, 1 << 15, 300_000
#: A single space between printed characters that no vocabulary or split rule treats as space.
_CUT = re.compile("(?<=[!-~À-ÿ]) (?=[!-~À-ÿ])")
_PRINTED = {chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))}
_SPACE_MARK = "▁"
_PAIR_BITS = 1 << 24


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printed Latin-1 characters
    stand for themselves, the other bytes in order for the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Both vocabularies and the bytes of their tokens."""

    def __init__(self, folder: str, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, a_file))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=os.path.join(folder, b_file))
        letters = byte_letters()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        # Bytes of each token by id; none where an id has no text of its own.
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for t, i in self.a.get_vocab().items():
            if i not in special:
                self.a_bytes[i] = bytes(letters[c] for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
                        else p.replace(_SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.width = np.array([len(str(i)) for i in range(most)])
        self.digits = np.zeros((most, int(self.width.max()) + 1), dtype=np.uint8)
        for i in range(most):
            self.digits[i, :self.width[i]] = list(str(i).encode())
        #: Whether texts may be cut at single spaces before B encodes them.
        self.separable = not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) for p in pieces)

    def stretches(self, text: str) -> list[str]:
        return _CUT.split(text) if self.separable else [text]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1)


@functools.lru_cache(maxsize=2)
def encoders(folder: str, a_file: str, b_file: str) -> Encoders:
    return Encoders(folder, a_file, b_file)


@dataclass
class Aligned:
    """Alignment of some stretches: counts and links of each, and the text of its groups."""

    sizes: np.ndarray       # per stretch: tokens of A, tokens of B, groups, 1 if both sides spell it
    pairs: np.ndarray       # the links (A id, B id) as one number each, stretch by stretch
    spelt: list[bytes]


def align(enc: Encoders, stretches: list[str]) -> Aligned:
    """Encode ``stretches`` in one go, a space before each, and align them.

    If their tokens do not spell them, or do not part where they do, each is tried by itself.
    """
    text = " ".join(stretches)
    raw = (" " + text).encode("utf-8", "surrogatepass")
    a_ids, b_ids = enc.encode(text)
    if b"".join([enc.a_bytes[i] for i in a_ids]) != raw or b"".join([enc.b_bytes[i] for i in b_ids]) != raw:
        return _one_by_one(enc, stretches)
    a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
    end_a, end_b = np.cumsum(enc.a_length[a]), np.cumsum(enc.b_length[b])
    place = np.searchsorted(end_b, end_a)
    last_a = np.flatnonzero(end_b[np.minimum(place, len(b) - 1)] == end_a)     # last token of each group
    last_b = place[last_a]
    ends = np.cumsum([1 + len(s.encode("utf-8", "surrogatepass")) for s in stretches])
    whole = np.searchsorted(end_a[last_a], ends)
    if not np.array_equal(end_a[last_a][np.minimum(whole, len(last_a) - 1)], ends):
        return _one_by_one(enc, stretches)
    sizes = np.stack([np.diff(last_a[whole], prepend=-1), np.diff(last_b[whole], prepend=-1), np.diff(whole, prepend=-1),
                      np.ones(len(stretches), dtype=np.int64)], axis=1)

    # Tokens group by group, A's before B's, each in decimal digits and with the mark that follows it.
    many_a, many_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    at_a = np.arange(len(a)) + np.repeat(np.cumsum(many_b) - many_b, many_a)
    at_b = np.arange(len(b)) + np.repeat(np.cumsum(many_a), many_b)
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[at_a], ids[at_b] = a, b
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
    rows, width = enc.digits[ids], enc.width[ids]
    rows[np.arange(len(ids)), width] = mark
    flat = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes()
    stop = np.cumsum(width + 1)[np.cumsum(sizes[:, 0] + sizes[:, 1]) - 1].tolist()
    spelt = [flat[x:y - 1] for x, y in zip([0, *stop[:-1]], stop, strict=True)]
    return Aligned(sizes, a[last_a] * _PAIR_BITS + b[last_b], spelt)


def _one_by_one(enc: Encoders, stretches: list[str]) -> Aligned:
    if len(stretches) == 1:
        return Aligned(np.zeros((1, 4), dtype=np.int64), np.zeros(0, np.int64), [b""])
    parts = [align(enc, [s]) for s in stretches]
    return Aligned(np.concatenate([p.sizes for p in parts]), np.concatenate([p.pairs for p in parts]), [p.spelt[0] for p in parts])


class Stretches:
    """Distinct stretches met so far: their sizes, links and group texts, by number."""

    def __init__(self, enc: Encoders):
        self.enc = enc
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.spelt: list[bytes] = []
        self.sizes = np.zeros((0, 4), dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)

    def learn(self, texts: set[str]) -> None:
        new = list(texts - self.number.keys())
        joined = [s for s in new if self.enc.separable and s[0] in _PRINTED and s[-1] in _PRINTED]
        alone = set(joined)
        blocks = [[s] for s in new if s not in alone]
        at, held = 0, 0
        for i, s in enumerate(joined, 1):
            held += len(s) + 1
            if held >= JOINED or i == len(joined):
                blocks.append(joined[at:i])
                at, held = i, 0
        parts = [align(self.enc, block) for block in blocks]
        for s in (s for block in blocks for s in block):
            self.number[s] = len(self.number)
        self.spelt += [x for p in parts for x in p.spelt]
        self.sizes = np.concatenate([self.sizes, *(p.sizes for p in parts)])
        self.pairs = np.concatenate([self.pairs, *(p.pairs for p in parts)])


# ------------------------------------------------------------------ bitmaps

_DOC_FIELDS = ["doc_id long", "chunk long", "number int", "n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string"]
_BIT_FIELDS = ["a int", "b int", "plane int", "dense boolean", "bits binary", "ones long"]
_SCHEMA = ", ".join(_DOC_FIELDS + _BIT_FIELDS)


def bitmaps(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> Iterator[tuple]:
    """Per plane ``(plane, pair, dense, bits, ones)`` for postings sorted by pair and document.

    Plane 0 is the pair's documents; plane j has the j-th digit of how often beyond once.
    """
    beyond = times - 1
    for plane in range(int(beyond.max(initial=0)).bit_length() + 1):
        on = slice(None) if plane == 0 else np.flatnonzero((beyond >> (plane - 1)) & 1)
        p, d = pair[on], doc[on].astype("<u2")
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        ones = np.diff(np.append(starts, len(p)))
        dense = 2 * ones > -(-docs // 8)
        sizes = np.where(dense, -(-docs // 8), 2 * ones)
        if dense.any():
            parts, at = [], 0
            for x in np.flatnonzero(dense).tolist():
                set_bits = np.zeros(docs, dtype=np.uint8)
                set_bits[d[starts[x]:starts[x] + ones[x]]] = 1
                parts += [d[at:starts[x]].tobytes(), np.packbits(set_bits).tobytes()]
                at = starts[x] + ones[x]
            raw = b"".join([*parts, d[at:].tobytes()])
        else:
            raw = d.tobytes()
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        bits = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        yield plane, p[starts], dense, bits, ones


def members(bits: pa.Array, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, document number) for every one of the given bitmaps."""
    offsets = np.frombuffer(bits.buffers()[1], dtype=np.int32)[bits.offset:bits.offset + len(bits) + 1].astype(np.int64)
    raw = np.frombuffer(bits.buffers()[2], dtype=np.uint8) if bits.buffers()[2] else np.zeros(0, np.uint8)
    rows, numbers = [], []
    sizes = np.where(dense, 0, np.diff(offsets))
    if sizes.any():
        keep = np.repeat(~dense, np.diff(offsets))
        short = raw[offsets[0]:offsets[-1]][keep]
        rows.append(np.repeat(np.arange(len(bits)), sizes // 2))
        numbers.append(short.view("<u2").astype(np.int64))
    for x in np.flatnonzero(dense).tolist():
        on = np.flatnonzero(np.unpackbits(raw[offsets[x]:offsets[x + 1]]))
        rows.append(np.full(len(on), x))
        numbers.append(on)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(numbers)


class Chunk:
    """The postings of up to 65,536 documents, batch by batch."""

    def __init__(self, number: int):
        self.number, self.docs, self.bytes = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, pair: np.ndarray, doc: np.ndarray) -> None:
        key, times = np.unique(pair << 16 | doc, return_counts=True)
        self.keys.append(key)
        self.times.append(times)

    def batches(self) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        key, times = key[order], np.concatenate(self.times)[order] if self.times else key
        for plane, pair, dense, bits, ones in bitmaps(key >> 16, key & 0xFFFF, times, self.docs):
            n = len(pair)
            if n:
                yield _rows(n, chunk=np.full(n, self.number), a=(pair // _PAIR_BITS).astype(np.int32), b=(pair % _PAIR_BITS).astype(np.int32),
                            plane=np.full(n, plane, np.int32), dense=dense, bits=bits, ones=ones.astype(np.int64))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _rows(n: int, **columns) -> pa.RecordBatch:
    """A batch of the common schema; columns not given are null."""
    fields = [f.split() for f in _SCHEMA.split(", ")]
    arrays = [pa.nulls(n, _ARROW[t]) if f not in columns else columns[f] if isinstance(columns[f], pa.Array)
              else pa.array(columns[f], type=_ARROW[t]) for f, t in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[f for f, _ in fields])


def _align(folder: str, a_file: str, b_file: str, chunk_docs: int, chunk_bytes: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(folder, a_file, b_file)
        known = Stretches(enc)
        first = TaskContext.get().partitionId() << 32
        chunk = Chunk(first)
        for batch in text_slices(batches, limit=batch_bytes):
            for at in range(0, batch.num_rows, chunk_docs):
                part = batch.slice(at, chunk_docs)
                if chunk.docs and (chunk.docs + part.num_rows > chunk_docs or chunk.bytes >= chunk_bytes):
                    yield from chunk.batches()
                    chunk = Chunk(chunk.number + 1)
                yield _documents(part, enc, known, chunk)
        yield from chunk.batches()
    return run


def _documents(batch: pa.RecordBatch, enc: Encoders, known: Stretches, chunk: Chunk) -> pa.RecordBatch:
    """The document rows of a batch; its links go to the chunk."""
    texts = batch.column(1).to_pylist()
    cut = [enc.stretches(t) if t else [] for t in texts]
    if len(known.number) > REMEMBERED:
        known.forget()
    known.learn(set().union(*cut))
    of = list(map(known.number.__getitem__, chain.from_iterable(cut)))
    numbers, many = np.array(of, dtype=np.int64), np.array([len(c) for c in cut])
    owner = np.repeat(np.arange(len(texts)), many)
    good = (many > 0) & (np.bincount(owner, weights=known.sizes[numbers, 3] == 0, minlength=len(texts)) == 0)
    counts = np.stack([np.bincount(owner, weights=known.sizes[numbers, k], minlength=len(texts)) for k in range(3)], axis=1).astype(np.int64)
    counts[~good] = 0
    stop = np.cumsum(many).tolist()
    digests = [hashlib.sha256(b";".join(map(known.spelt.__getitem__, of[x:y]))).hexdigest() if ok else ""
               for x, y, ok in zip([0, *stop[:-1]], stop, good.tolist(), strict=True)]
    use = good[owner]
    numbers, owner = numbers[use], owner[use]
    if len(numbers):
        width = known.sizes[numbers, 2]
        begin = np.cumsum(known.sizes[:, 2]) - known.sizes[:, 2]
        at = np.repeat(begin[numbers] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        chunk.add(known.pairs[at], np.repeat(chunk.docs + owner, width))
    out = _rows(len(texts), doc_id=batch.column(0), chunk=np.full(len(texts), chunk.number),
                number=np.arange(chunk.docs, chunk.docs + len(texts), dtype=np.int32), n_a=counts[:, 0], n_b=counts[:, 1],
                n_groups=counts[:, 2], n_links=counts[:, 2], groups_sha256=digests)
    chunk.docs += len(texts)
    chunk.bytes += batch.column(1).nbytes
    return out


# ------------------------------------------------------------------ scores

def _return_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps with their pair's count come chunk by chunk; each chunk's documents add them up."""
    number, sums = None, None

    def finished() -> pa.RecordBatch:
        on = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(on), number)), pa.array(on.astype(np.int32)), pa.array(sums[1][on]), pa.array(sums[0][on])],
                                          names=["chunk", "number", "n_best", "count_sum"])

    for batch in batches:
        chunks = batch.column(0).to_numpy()
        for part in np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(chunks)) + 1):
            if not len(part):
                continue
            rows = batch.slice(int(part[0]), len(part))
            if chunks[part[0]] != number:
                if number is not None:
                    yield finished()
                number, sums = int(chunks[part[0]]), (np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64))
            plane = rows.column(1).to_numpy()
            weight = np.left_shift(np.int64(1), np.maximum(plane - 1, 0).astype(np.int64))
            row, doc = members(rows.column(3), rows.column(2).to_numpy(zero_copy_only=False))
            np.add.at(sums[0], doc, (weight * rows.column(4).to_numpy())[row])
            np.add.at(sums[1], doc, (weight * rows.column(5).to_numpy(zero_copy_only=False))[row])
    if number is not None:
        yield finished()


@dataclass
class Alignment:
    """``documents``: one row per document; ``pairs``: a, b, n_docs, n_links, best (b's highest n_links)."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE,
                     chunk_docs: int = CHUNK_DOCS, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = BATCH_BYTES) -> Alignment:
    """Align two tokenizers over ``docs(doc_id, text, ...)``; the files lie in ``folder`` on every node.

    ``documents`` has doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its B id's
    highest count, ties included), count_sum (sum of its links' pair counts) and groups_sha256.
    Chunks hold at most 65,536 documents; their size changes no result.
    Tokens have bytes, so one token of each side ends at a cut and links equal groups.

    * Null and empty texts, and texts that either side does not spell byte by byte: zeros and ''.
    * Strings of special tokens are plain text. Texts are encoded whole.
    * Repeated rows and repeated or null doc_ids are documents of their own; each adds its links.
    * Extra columns are not read; an empty table gives two empty tables.
    """
    both = written(docs.select("doc_id", "text").mapInArrow(_align(folder, a_file, b_file, chunk_docs, chunk_bytes, batch_bytes), _SCHEMA), "aligned")
    postings = both.where("plane is not null").select("chunk", "a", "b", "plane", "dense", "bits", "ones")
    weight = F.expr("shiftleft(1L, greatest(plane - 1, 0))")
    links = F.sum(F.col("ones") * weight)
    counted = written(postings.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("ones"))).alias("n_docs"), links.alias("n_links")), "pairs")
    top = counted.groupBy("b").agg(F.max("n_links").alias("best"))
    pairs = written(counted.join(top, "b").select("a", "b", "n_docs", "n_links", "best"), "scored")
    score = pairs.select("a", "b", F.col("n_links").alias("count"), (F.col("n_links") == F.col("best")).cast("long").alias("is_best"))
    led = (postings.join(score, ["a", "b"]).select("chunk", "plane", "dense", "bits", "count", "is_best")
           .repartition("chunk").sortWithinPartitions("chunk")
           .mapInArrow(_return_scores, "chunk long, number int, n_best long, count_sum long"))
    zero = F.lit(0).cast("long")
    documents = both.where("number is not null").join(led, ["chunk", "number"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return Alignment(documents, pairs)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13 over all documents, as its contract states."""
    return align_tokenizers(table(spark, sf_dir, "documents")).documents
