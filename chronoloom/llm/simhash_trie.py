"""Near copies by SimHash, linked by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoloom.session import cut_lineage, stage

#: Fingerprints of a block of bits that meet in one task; larger blocks are cut, and the cuts meet in pairs.
BLOCK = 50_000
#: Node pairs that are followed at once, and links that are kept before they are merged into trees.
FRONTIER, LINKS = 500_000, 2_000_000


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash of lower-cased words; bytes.split() and lower() know exactly the ASCII rules wanted."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 65536):
        part = words[at:at + 65536 + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(42)), np.dtype(">u8"))
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, carry: tuple = ()) -> DataFrame:
    """(key, fingerprint as a signed long, carry).  NULL counts as empty; a text without words has fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t or b"", shingle) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), *batch.columns[1:]],
                                             names=["_fp", *batch.schema.names[1:]])

    rows = docs.select(F.col(text).cast("string").cast("binary").alias("_text"), F.col(key).alias("_key"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"_fp long, {kinds}")


def merged(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of components after adding links a-b: the smallest member each."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label != label[label]).any():
            label = label[label]


def trie_components(keys: np.ndarray, group: np.ndarray, most: int, skip: int) -> np.ndarray:
    """Components of fingerprints of the same group that differ in at most ``most`` bits.

    ``keys`` are sorted within sorted ``group``; a group is a trie whose nodes
    are ranges of it, ``skip`` bits below its root, which all members share.
    Pairs of nodes go down together, bit by bit; a pair of unlike children costs
    one bit, and a pair beyond the budget is dropped with all below it.  Small
    pairs are compared in full.
    """
    n = len(keys)
    label = np.arange(n)
    edges = np.flatnonzero(np.diff(group, prepend=group[:1] - 1) if n else group)
    lo, hi = edges, np.append(edges[1:], n)
    many = hi - lo > 1
    todo = [(skip, lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int8))]
    found: list[np.ndarray] = []
    held = 0
    ones: dict[int, np.ndarray] = {}

    def merge() -> None:
        nonlocal label, found, held
        if found:
            a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            label, found, held = merged(n, a, b, label), [], 0

    while todo:
        depth, al, ah, bl, bh, cost = todo.pop()
        if len(al) > FRONTIER:
            todo += [(depth, *(x[k:k + FRONTIER] for x in (al, ah, bl, bh, cost))) for k in range(0, len(al), FRONTIER)]
            continue
        small = ((ah - al) * (bh - bl) <= 64) | (depth >= 64)
        if small.any():
            rows, cols = (ah - al)[small], (bh - bl)[small]
            size = rows * cols
            pair = np.repeat(np.arange(len(size)), size)
            inside = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            a = al[small][pair] + inside // cols[pair]
            b = bl[small][pair] + inside % cols[pair]
            near = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= most)
            if near.any():
                found.append((a[near], b[near]))
                held += int(near.sum())
                if held > LINKS:
                    merge()
        al, ah, bl, bh, cost = (x[~small] for x in (al, ah, bl, bh, cost))
        if not len(al):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        count = ones[depth]
        am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
        self_ = (al == bl) & (ah == bh)
        step = [(al, am, bl, bm, cost), (am, ah, bm, bh, cost), (al, am, bm, bh, cost + 1),
                tuple(x[~self_] for x in (am, ah, bl, bm, cost + 1))]
        al, ah, bl, bh, cost = (np.concatenate(x) for x in zip(*step))
        on = (cost <= most) & (al < ah) & (bl < bh) & ((al != bl) | (ah - al > 1))
        todo.append((depth + 1, al[on], ah[on], bl[on], bh[on], cost[on]))
    merge()
    return label


def links(prints: DataFrame, most: int = 3, block: int = BLOCK) -> DataFrame:
    """A forest (_a, _b) that connects what links of at most ``most`` differing bits connect.

    ``prints`` has distinct ``_fp``.  Of most+1 blocks of bits two linked
    fingerprints share one, so each is sent to most+1 tries that have that
    block in front, where no bit may differ.  A block that more than ``block``
    fingerprints share is cut by hash, and every two cuts meet.  No link is
    lost; within a task only trees of links are kept.
    """
    blocks = most + 1
    width = [64 * (k + 1) // blocks - 64 * k // blocks for k in range(blocks)]
    first = [64 * k // blocks for k in range(blocks)]
    turned = lambda k: F.shiftleft("_fp", k).bitwiseOR(F.shiftrightunsigned("_fp", 64 - k)) if k else F.col("_fp")
    rows = prints.select(F.posexplode(F.array(*[turned(k) for k in first])).alias("_block", "_bits"))
    front = F.element_at(F.array(*[F.shiftrightunsigned("_bits", 64 - w) for w in width]), F.col("_block") + 1)
    rows = stage(rows.withColumn("_value", front))
    shared = (rows.groupBy("_block", "_value").agg(F.ceil(F.count("*") / block).alias("_cuts"), F.count("*").alias("_n"))
              .filter("_n > 1"))
    met = rows.join(shared, ["_block", "_value"])
    cut = F.pmod(F.xxhash64("_bits"), "_cuts")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1))
    met = met.withColumns({"_cut": cut}).withColumn("_other", other)
    met = met.withColumn("_pair", F.array(F.least("_cut", "_other"), F.greatest("_cut", "_other")))
    total = shared.agg(F.sum(F.col("_n") * F.col("_cuts"))).first()[0] or 0
    tasks = max(1, -(-total // (2 * block)))
    met = met.withColumn("_task", F.pmod(F.xxhash64("_block", "_value", "_pair"), F.lit(tasks)))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        low = rows["_low"].to_numpy(np.int64)
        for k in range(blocks):
            mine = rows["_block"].to_numpy() == k
            bits = rows["_bits"].to_numpy(np.int64)[mine].view(np.uint64)
            keys, codes = np.unique(np.stack([rows["_value"].to_numpy(np.int64)[mine], low[mine]], 1), axis=0,
                                    return_inverse=True)
            order = np.lexsort((bits, codes.reshape(-1)))
            bits, codes = bits[order], codes.reshape(-1)[order]
            label = trie_components(bits, codes, most, width[k])
            away = np.flatnonzero(label != np.arange(len(label)))
            back = bits >> np.uint64(first[k]) if not first[k] else (
                (bits >> np.uint64(first[k])) | (bits << np.uint64(64 - first[k])))
            out.append(pd.DataFrame({"_a": back[away].view(np.int64), "_b": back[label[away]].view(np.int64)}))
        return pd.concat(out)

    low = F.col("_pair")[0] * F.lit(1 << 31) + F.col("_pair")[1]
    return (met.select("_task", "_block", "_value", "_bits", low.alias("_low")).groupBy("_task")
            .applyInPandas(join, "_a long, _b long"))


def components(edges: DataFrame) -> DataFrame:
    """(_fp, _root) for every node of an edge: the smallest number it reaches.

    Alternates two steps: each node joins its larger neighbours, then its
    smaller ones, to the smallest of all; rounds grow with the logarithm of the
    longest path.  A hub is a hot key of a plain join, which adaptive execution
    splits; its minimum is aggregated before the shuffle.
    """
    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m"))
        return pairs.join(least, "_a")

    def signature(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()

    down = lambda d: d.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).filter("_a > _b").distinct()
    pairs = cut_lineage(down(edges))
    before = signature(pairs)
    while before[0]:
        both = pairs.union(pairs.select("_b", "_a"))
        large = down(star(both).filter("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b")))
        joined = star(large)
        small = down(joined.select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
                     .union(joined.select("_a", F.col("_m").alias("_b"))))
        pairs = cut_lineage(small)
        now = signature(pairs)
        if now == before:
            break
        before = now
    return pairs.groupBy("_a").agg(F.min("_b").alias("_root")).withColumnRenamed("_a", "_fp")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 3,
                carry: tuple = ()) -> DataFrame:
    """One row per document: key, ``fingerprint`` (hex), ``component_id``, ``carry``.

    Documents whose fingerprints differ in at most ``most`` bits are linked;
    ``component_id`` is the smallest key reachable.  Equal fingerprints are one
    node, so copies are never expanded to pairs.  NULL and wordless texts have
    fingerprint 0 and are linked like any other; NULL keys are passed over for
    the smallest unless there is no other; repeated rows each give a row.  An
    empty table gives an empty one.
    """
    rows = stage(fingerprints(docs, key, text, shingle, carry))
    prints = stage(rows.groupBy("_fp").agg(F.min("_key").alias("_least")))
    roots = components(links(prints, most))
    placed = prints.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = placed.join(least, "_root").select("_fp", "component_id")
    return rows.join(named, "_fp").select(
        F.col("_key").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", *carry)
