"""Best-fit packing of tokenised documents: patterns by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoloom.llm.ranks import positions
from chronoloom.session import stage

#: White space as the tokenizer's pattern sees it (fixed values).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space and what follows it.  A token never reaches over such a border.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BORDER = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
DOUBLE = re.compile(f"[{SPACE}][{SPACE}]")
#: Characters that are cut into chunks at once, and chunks of each of two generations that a worker remembers.
SEGMENT, REMEMBERED = 1 << 20, 400_000

#: In front of a piece that no space precedes; pieces that start a line, or are empty, need none.
MARK, LINE = "\x00", ("", "\n")
AS_IS = (MARK, "\n")

_CODERS: dict[tuple[str, bool], Coder] = {}


class Coder:
    """Byte-level BPE by the ``tokenizers`` library, with a memory of chunks.

    Texts are cut where white space follows something else; the pattern of
    byte-level BPE always ends a token there, so chunks can be looked up one by
    one.  Chunks not seen before are encoded together, in one call.  The
    strings of added tokens become those tokens, as by default in the library;
    with ``plain`` they are text like any other.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        added = {t.content: k for k, t in self.coder.get_added_tokens_decoder().items()}
        self.added = {} if plain else {c: np.array([k], "<u4").tobytes() for c, k in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.border = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if self.added else None
        tokens = self.coder.get_vocab()
        self.bytes_of = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, k in tokens.items():
            self.bytes_of[k] = len(token)  # byte-level vocabularies write a byte as a character
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[list[str]]) -> None:
        """Encodes chunks not known: those after a space, which are written without it, many to a call."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = {c for each in chunks for c in each if c not in known}
        joint, alone = [], []
        for c in new:
            if c in older:
                known[c] = older[c]
            elif c[:1] in LINE or c[0] == MARK:
                alone.append(c)
            else:
                joint.append(c)
        for c, ids in zip(alone, self._ids([c[1:] if c[:1] == MARK else c or " " for c in alone])):
            known[c] = ids.tobytes()
        parts = [joint[at:at + 2000] for at in range(0, len(joint), 2000)]
        texts = [" " + " ".join(part) for part in parts]
        for part, text, ids in zip(parts, texts, self._ids(texts)):
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + 1)
            cuts = (4 * np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "left") + 4).tolist()
            raw = ids.tobytes()
            known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))))

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Pieces whose ids, put together, are those of the text.

        Where single spaces and line ends divide words, which is nearly
        everywhere, a piece is what follows a space; with MARK in front it is
        meant as it stands.
        """
        if DOUBLE.search(text):
            return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() and c[1] not in AS_IS else MARK + c
                    for c in CHUNK.findall(text)]
        if MARK in text:
            return [MARK + c for c in CHUNK.findall(text)]
        found = text.replace("\n", " \n").split(" ")
        if found[0]:
            found[0] = MARK + found[0]
        else:
            del found[0]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; added tokens divide a text, what lies between is encoded by itself."""
        if not self.border:
            return self.encode_plain(texts)
        parts = [self.border.split(t) if any(c in t for c in self.added) else [t] for t in texts]
        ids = iter(self.encode_plain([x for each in parts for x in each[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(ids) for k, x in enumerate(each)) for each in parts]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens; long ones segment by segment."""
        out = [b""] * len(texts)
        todo = [(k, 0) for k, text in enumerate(texts) if text]
        while todo:
            chunks, rest = [], []
            for k, at in todo:
                text = texts[k]
                border = BORDER.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
                chunks.append(self.chunks(text[at:border.end()] if border else text[at:] if at else text))
                if border:
                    rest.append((k, border.end()))
            self.learn(chunks)
            for (k, _), each in zip(todo, chunks):
                out[k] += b"".join(map(self.known.__getitem__, each))
            todo = rest
        return out


def coder(path: str, plain: bool = False) -> Coder:
    """One coder per worker and file."""
    if (path, plain) not in _CODERS:
        _CODERS[path, plain] = Coder(path, plain)
    return _CODERS[path, plain]


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
           most: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``most`` tokens: (key, piece, start, length, ids_crc32[, ids]).

    A document's ids are followed by ``end_id``.  A longer one is cut so that
    its first piece is the shorter one.  NULL text counts as empty, which is one
    piece of the end alone.  Repeated rows each give their pieces, NULL keys are
    keys, further columns are ignored, whatever their names; an empty table
    gives an empty one.
    """
    names = ["_key", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, last = coder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0)
            rows: list[list] = [[] for _ in names[1:]]
            which: list[int] = []
            for at in range(0, len(texts), 512):
                block = [t or "" for t in texts.slice(at, 512).to_pylist()]
                for k, ids in enumerate(code.encode(block)):
                    ids += last
                    n = len(ids) // 4
                    head = n % most or min(n, most)
                    a, number = 0, 0
                    while a < n:
                        b = a + (most if number else head)
                        cut = ids[4 * a:4 * b]
                        which.append(at + k)
                        for column, value in zip(rows, (number, a, b - a, zlib.crc32(cut), cut)):
                            column.append(value)
                        a, number = b, number + 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(which, pa.int32())), *[pa.array(v, t) for v, t in zip(rows, kinds)]], names=names)

    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)


def candidate_patterns(most: int) -> np.ndarray:
    """All patterns of one, two or three lengths that fill a sequence exactly, as rows padded with 0."""
    rows = [np.array([[most, 0, 0]])]
    a = np.arange(1, most // 2 + 1)
    rows.append(np.stack([most - a, a, 0 * a], 1))
    for small in range(1, most // 3 + 1):
        b = np.arange(small, (most - small) // 2 + 1)
        rows.append(np.stack([most - small - b, b, np.full_like(b, small)], 1))
    return np.concatenate(rows)


def fit(counts: np.ndarray, patterns: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x that minimises |D (A x - counts)|², A holding how often a pattern has a length.

    D weighs lengths that few patterns have more: long pieces have few partners
    and cost most if they are left over, and the fit converges sooner.
    Accelerated projected gradient with restarts; A is never built, both its
    products are lookups in the three columns of the patterns.
    """
    size = len(counts)
    weight = 1 / np.sqrt(np.maximum(1, sum(np.bincount(patterns[:, k], minlength=size) for k in range(3))))
    weight[0] = 0
    into = lambda x: weight * sum(np.bincount(patterns[:, k], x, size) for k in range(3))
    back = lambda r: (r := weight * r)[patterns[:, 0]] + r[patterns[:, 1]] + r[patterns[:, 2]]
    counts = weight * counts
    probe = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue, for the step
        probe = back(into(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(patterns))
    t, step = 1.0, 0.95 / norm
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(into(y) - counts))
        if np.dot(y - new, new - x) > 0:
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan(histogram: dict[int, int], most: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of sequences that hold exactly the lengths counted in the histogram.

    Bounded by the number of lengths and patterns, not by that of documents:
    the fit is rounded along its running sum, patterns that ask for more than
    is left get less, the rest is fitted again while that takes much of it, and what no pattern takes is packed best-fit, longest
    first, many equal pieces at a time.
    """
    left = np.zeros(most + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = [(int(left[most]), (most,))] if left[most] else []
    left[most] = 0
    patterns, before = candidate_patterns(most)[1:], float("inf")
    while left.sum() < 0.97 * before:  # what rounding left over is fitted again
        before = left.sum()
        there = left > 0
        there[0] = True
        patterns = patterns[there[patterns].all(1)]
        if not len(patterns):
            break
        running = np.floor(np.cumsum(fit(left.astype(float), patterns)) + 0.5).astype(np.int64)
        repeats = np.diff(running, prepend=0)
        for k in np.flatnonzero(repeats):
            lengths = tuple(int(v) for v in patterns[k] if v)
            need = {v: lengths.count(v) for v in lengths}
            n = min([int(repeats[k]), *[int(left[v]) // m for v, m in need.items()]])
            if n > 0:
                out.append((n, lengths))
                for v, m in need.items():
                    left[v] -= n * m
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room -> lengths -> sequences
    for length in range(most, 0, -1):
        n = int(left[length])
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                times = most // length
                for fits in (times, n % times):
                    made = n // times if fits == times else 1
                    if made and fits:
                        bins = open_.setdefault(most - fits * length, {})
                        bins[(length,) * fits] = bins.get((length,) * fits, 0) + made
                    if fits != times:
                        break
                n = 0
                continue
            bins = open_[room]
            lengths, have = bins.popitem()
            fits = min(room // length, n)
            used = min(have, n // fits)
            if have > used:
                bins[lengths] = have - used
            elif not bins:
                del open_[room]
            to = open_.setdefault(room - fits * length, {})
            filled = lengths + (length,) * fits
            to[filled] = to.get(filled, 0) + used
            n -= used * fits
    return out + [(n, lengths) for bins in open_.values() for lengths, n in bins.items()]


def pack(parts: DataFrame, most: int = 2048, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, gapless in each sequence.

    Only the histogram of lengths (``most`` numbers) reaches the driver, only
    the plan goes back: its size is bounded by the number of patterns, not by
    the corpus.  Pieces of one length are numbered in a seeded order without
    collecting them, and the number finds its place in the plan.  An empty table
    gives an empty one; equal pieces are interchangeable.
    """
    counted = {int(r["length"]): int(r["count"]) for r in parts.groupBy("length").count().collect()}
    first, slots = 0, []
    for n, lengths in plan(counted, most):
        at = 0
        for length in lengths:
            slots.append((length, n, first, at))
            at += length
        first += n
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    begin = np.zeros(len(table), np.int64)  # pieces of the same length before a slot
    if len(table):
        sums = np.cumsum(table[:, 1])
        own = np.searchsorted(table[:, 0], table[:, 0], "left")
        begin = sums - table[:, 1] - np.where(own > 0, sums[own - 1], 0)
    codes = (table[:, 0] << 48) | begin
    shared = parts.sparkSession.sparkContext.broadcast((codes, begin, table[:, 2], table[:, 3]))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        codes, begin, sequence, offset = shared.value
        number = number.to_numpy(np.int64)
        at = np.searchsorted(codes, (length.to_numpy(np.int64) << 48) | number, "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + number - begin[at], "offset": offset[at]})

    numbered = positions(parts, ["length"], [key, "piece", "start"], seed=seed)
    return numbered.withColumn("_at", place("length", "_place")).select(
        *parts.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, most: int = 2048, key: str = "doc_id", text: str = "text",
                   keep_ids: bool = False, seed: int = 0) -> DataFrame:
    """Tokenises, cuts and packs; one row per piece, with its ids if asked for."""
    return pack(stage(pieces(docs, path, key, text, most=most, keep_ids=keep_ids)), most, key, seed)
