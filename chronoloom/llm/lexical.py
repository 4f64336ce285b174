"""Ranked lexical search: tiles of item weights times tiles of document impacts, in exact float64 products.

The terms of a block of items are a compact vocabulary.  One pass over the
documents counts them, a second multiplies dense tiles (documents x terms by
terms x items) and keeps, per task, the best documents of each item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronoloom.session import stage

#: Bytes inside a term: digits, letters and all of other characters; A-Z become a-z, the rest ends a term.
_INSIDE = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _INSIDE else 0x20 for b in range(256))
#: Documents, terms and items of a tile; terms of items (with repeats) that go to the tasks at once.
DOCS, TERMS, ITEMS, BLOCK = 1024, 4096, 512, 400_000
#: An impact is below this, and a product's sums stay below 2^53.
IMPACT = 1_000_000
LIMIT = ((1 << 53) - 1) // IMPACT


def terms(text: bytes) -> list[bytes]:
    """Terms in order: UTF-8 never uses an ASCII byte inside another character, so bytes can be judged alone."""
    return text.translate(TABLE).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def damping(n: int, docs: int, total: int) -> int:
    """A document's m; Python integers, since n x docs may pass 64 bits."""
    return 75 + 25 * n * docs // total


@dataclass
class Block:
    """Items that are searched together: their vocabulary, and how often an item has a term."""

    words: dict[bytes, int]
    items: int
    item: np.ndarray
    term: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Block:
        words: dict[bytes, int] = {}
        item, term, count = [], [], []
        for k, text in enumerate(texts):
            own = np.array([words.setdefault(w, len(words)) for w in terms(text)], np.int64)
            there, times = np.unique(own, return_counts=True)
            item.append(np.full(len(there), k))
            term.append(there)
            count.append(times)
        join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
        return cls(words, len(texts), join(item), join(term), join(count))


def layers(item: np.ndarray, term: np.ndarray, weight: np.ndarray, limit: int = LIMIT) -> list[tuple]:
    """Weights as sums of layers in which no item's total passes ``limit``, so that a layer's product is exact."""
    out = []
    order = np.lexsort((term, item))
    item, term, weight = item[order], term[order], weight[order]
    while True:
        there = weight > 0
        item, term, weight = item[there], term[there], weight[there]
        if not len(item):
            return out
        # saturating sums per item; a single weight may pass the limit
        capped = np.minimum(weight, limit)
        sums = np.cumsum(capped) - capped
        first = np.searchsorted(item, item, "left")
        before = sums - sums[first]
        take = np.clip(limit - before, 0, capped)
        out.append((item, term, take))
        weight = weight - take


def dense_products(n_docs: int, rows: np.ndarray, cols: np.ndarray, impact: np.ndarray, weighted: list[tuple],
                   vocabulary: int, first: int, items: int, width: int = TERMS) -> np.ndarray:
    """Scores (document x item, int64) of items ``first`` to ``first + items``.

    ``rows``, ``cols``, ``impact`` are sorted by ``cols``.  A layer's float64
    sums stay below 2^53 over all its tiles; layers are added as integers.
    """
    out = np.zeros((n_docs, items), np.int64)
    for item, term, weight in weighted:
        part = np.zeros((n_docs, items))
        mine = (item >= first) & (item < first + items)
        own_item, own_term, own_weight = item[mine] - first, term[mine], weight[mine]
        for at in range(0, vocabulary, width):
            here = (own_term >= at) & (own_term < at + width)
            if not here.any():
                continue
            used, place = np.unique(own_term[here], return_inverse=True)
            right = np.zeros((len(used), items))
            right[place, own_item[here]] = own_weight[here]
            lo, hi = np.searchsorted(cols, [at, at + width])
            slot = np.searchsorted(used, cols[lo:hi])
            known = (slot < len(used)) & (used[np.minimum(slot, len(used) - 1)] == cols[lo:hi])
            left = np.zeros((n_docs, len(used)))
            left[rows[lo:hi][known], slot[known]] = impact[lo:hi][known]
            part += left @ right
        out += part.astype(np.int64)
    return out


class Best:
    """The k best documents of each item so far: larger score first, then smaller key, NULL keys last."""

    def __init__(self, k: int):
        self.k = k
        self.item = self.score = self.key = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, scores: np.ndarray, keys: np.ndarray, nulls: np.ndarray, first: int, bars: np.ndarray) -> None:
        """Adds a tile; a document tied with the k-th of its tile is kept until keys decide."""
        rank = min(self.k, len(scores))
        bar = np.maximum(np.partition(scores, len(scores) - rank, axis=0)[len(scores) - rank], 1)
        if rank < self.k:
            bar = np.ones_like(bar)
        doc, item = np.nonzero(scores >= np.maximum(bar, bars[first:first + scores.shape[1]])[None])
        self.item = np.concatenate([self.item, item + first])
        self.score = np.concatenate([self.score, scores[doc, item]])
        self.key = np.concatenate([self.key, keys[doc]])
        self.null = np.concatenate([self.null, nulls[doc]])

    def cut(self, items: int) -> np.ndarray:
        """Keeps k of each item and gives the score that a later document must reach."""
        order = np.lexsort((self.key, self.null, -self.score, self.item))
        item = self.item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, "left")
        order = order[place < self.k]
        self.item, self.score, self.key, self.null = (x[order] for x in (self.item, self.score, self.key, self.null))
        bars = np.ones(items, np.int64)
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        bars[self.item[last]] = self.score[last]
        return bars


def counted(docs: DataFrame, block: Block, key: str, text: str) -> DataFrame:
    """(_key, _n, _terms, _tf) of documents with a term: how often each has the block's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(block.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch in batches:
            n, ends, there, times = [], [0], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for value in batch.column(1):
                words = terms(value.as_py() or b"")
                own = np.array([k for k in map(place, words) if k is not None], np.int32)
                cols, tf = np.unique(own, return_counts=True)
                n.append(len(words))
                there.append(cols)
                times.append(tf)
                ends.append(ends[-1] + len(cols))
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x), kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), lists(there, pa.int32()), lists(times, pa.int64())],
                names=["_key", "_n", "_terms", "_tf"])

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "_key long, _n long, _terms array<int>, _tf array<long>").filter("_n > 0")


def ranked(rows: DataFrame, block: Block, weighted: list[tuple], docs: int, total: int, k: int) -> DataFrame:
    """(_item, _key, _score): each task's k best documents of every item."""
    shared = rows.sparkSession.sparkContext.broadcast((weighted, len(block.words), block.items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted, vocabulary, items = shared.value
        best, bars = Best(k), np.ones(items, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                nulls = np.array(part.column(0).is_null())
                keys = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                m = np.array([damping(n, docs, total) for n in part.column(1).to_pylist()], np.int64)
                cols = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False)
                line = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                order = np.argsort(cols, kind="stable")
                cols, line, impact = cols[order], line[order], impacts(tf, m[line])[order]
                for first in range(0, items, ITEMS):
                    wide = min(ITEMS, items - first)
                    scores = dense_products(part.num_rows, line, cols, impact, weighted, vocabulary, first, wide)
                    best.add(scores, keys, nulls, first, bars)
                bars = best.cut(items)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.key, mask=best.null), pa.array(best.score)], names=["_item", "_key", "_score"])

    return rows.mapInArrow(run, "_item long, _key long, _score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item, rank, key, score): the ``k`` highest-scoring documents of each item with a score above 0.

    Items are dealt by hash to blocks of about ``block`` terms; a block's
    vocabulary and counts are what the driver and each task hold, and one more
    block costs one more scan of the documents, so neither side is ever
    collected or broadcast whole.  Only k rows per item leave a task.

    Each row is a document or an item of its own: repeated rows all rank, equal
    scores by ascending key, NULL keys last.  NULL and empty texts have no
    terms: such documents count nowhere, such items give no row.  Keys of
    documents are longs.  Empty tables give an empty result; further columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType
    out = f"{item_key} {kind.simpleString()}, rank int, {key} long, score long"
    asked = items.select(F.col(item_key).alias("_id"), F.col(item_text).cast("string").cast("binary").alias("_text"))
    asked = asked.filter(F.octet_length("_text") > 0)
    size = asked.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / (4 * block)))  # a term and what ends it seldom take under four bytes
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_text", "_id"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        own = asked.filter(F.col("_block") == b).select("_id", "_text").collect()  # bounded by the block
        if not own:
            continue
        part = Block.of([bytes(r["_text"]) for r in own])
        rows = stage(counted(docs, part, key, text))
        n, total = rows.agg(F.count("*"), F.sum("_n")).first()
        if not n:
            break
        held = rows.select(F.explode("_terms").alias("_term")).groupBy("_term").count().collect()  # one row per word of the block
        df = dict(map(tuple, held))
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(v, 0) + 1)))
                           for v in range(len(part.words))] + [0], np.int64)
        weighted = layers(part.item, part.term, part.count * weight[part.term])
        best = ranked(rows, part, weighted, n, total, k)
        names = spark.createDataFrame([(i, r["_id"]) for i, r in enumerate(own)], f"_item long, {item_key} {kind.simpleString()}")
        window = Window.partitionBy("_item").orderBy(F.desc("_score"), F.asc_nulls_last("_key"))
        first = (best.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
                 .join(names, "_item").select(item_key, "rank", F.col("_key").alias(key), F.col("_score").alias("score")))
        found = first if found is None else found.union(first)
    return spark.createDataFrame([], out) if found is None else found
