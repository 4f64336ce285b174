"""Jaccard join of word n-gram sets by a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are distinct sets (equal sets are one row), its
columns are n-grams, the commonest last.  A pair of rows that is alike enough
must share one of the first columns of each, as many as its size allows to
differ; so the product of those columns names all candidates, and pairs whose
sizes or parities rule them out are dropped inside the block.  The product over
all columns is then accumulated for the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.llm.simhash_trie import components
from chronoloom.operators.skew import join_one
from chronoloom.session import stage

#: Cells of the table that tells common n-grams; any table gives right results, it only orders columns.
CELLS = 1 << 18
#: Longs of parities for sets of up to 512 n-grams; they double with the size.
PARITY = 4
#: Rows of a column that meet in a block, pairs that are expanded at once, slots of the table of rows to fetch.
BLOCK, PAIRS, SLOTS = 4_096, 1 << 21, 1 << 20


def grams(text: bytes, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the set of n-word shingles of the whole text; fewer words are one shingle, none no set."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= n:
        return np.array([xxh64_intdigest(b" ".join(words), 7)] if words else [], np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(n))))
    return np.unique(np.fromiter(map(xxh64_intdigest, joined, repeat(7)), np.uint64, len(words) - n + 1))


def cell_of(tokens: np.ndarray, cells: int) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % cells


def least_size(percent: int) -> int:
    """Two unlike sets of which one is smaller cannot be linked: their union has one more than they share."""
    return -(-percent // (100 - percent))


def prefix_of(n: int, percent: int) -> int:
    """A linked set shares ceil(percent n / 100) with one of n, so one of the first n less that, and one more."""
    return n - -(-percent * n // 100) + 1


def parity(tokens: np.ndarray) -> np.ndarray:
    """Whether each slot holds an odd number of n-grams; slots double with the size, and halve by XOR."""
    width = PARITY
    while width * 128 < len(tokens):
        width *= 2
    odd = np.bincount((tokens % np.uint64(64 * width)).astype(np.int64), minlength=64 * width) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def binary_text(docs: DataFrame, text: str) -> Column:
    return F.col(text).cast("string").cast("binary")


def common_cells(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """In how many documents each cell's n-grams are: a table of fixed size, counted over all rows."""
    cells = CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.int64)
        for batch in batches:
            for value in batch.column(0):
                np.add.at(own, cell_of(grams(value.as_py() or b"", shingle), cells), 1)
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(own[there])], names=["_cell", "_n"])

    found = docs.select(binary_text(docs, text)).mapInArrow(run, "_cell int, _n long").groupBy("_cell").agg(F.sum("_n").alias("_n"))
    table = np.zeros(cells, np.int64)
    for r in found.collect():  # one row per cell at most
        table[r["_cell"]] = r["_n"]
    return table


def sets(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(_key, _set, _n, _parity, _first, _centre) per document.

    ``_set`` names the set (its hashes hashed to 128 bits), ``_first`` are its
    first columns, ``_centre`` is larger the commoner its n-grams are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_cells(docs, text, shingle))
    least = least_size(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        count = shared.value
        common = np.log2(count + 1.0)
        for batch in batches:
            names, sizes, odd, first, centre = [], [], [], [], []
            for value in batch.column(1):
                own = grams(value.as_py() or b"", shingle)
                names.append(xxh128_digest(own.tobytes()))
                sizes.append(len(own))
                if len(own) < least:
                    odd.append([])
                    first.append([])
                    centre.append(0)
                    continue
                cells = cell_of(own, len(count))
                k = prefix_of(len(own), percent)
                order = np.lexsort((own, count[cells]))[:k]
                odd.append(parity(own))
                first.append(own[order].view(np.int64))
                centre.append(int(common[cells].mean() * 1e6))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(odd, longs),
                 pa.array(first, longs), pa.array(centre, pa.int64())],
                names=["_key", "_set", "_n", "_parity", "_first", "_centre"])

    rows = docs.select(F.col(key).alias("_key"), binary_text(docs, text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, _set binary, _n long, _parity array<long>, _first array<long>, _centre long")


def size_bound(small: Column, large: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked; order does not matter."""
    return F.least(small, large) * 100 >= F.greatest(small, large) * percent


def folded(longs: Column, to: Column) -> Column:
    """Parities brought to ``to`` longs, which is their number or half of it."""
    half = F.zip_with(F.slice(longs, F.lit(1), to), F.slice(longs, to + 1, to), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(longs) > to, half).otherwise(longs)


def every(longs: Column, first: int, step: int = PARITY) -> Column:
    """XOR of every ``step``-th long, which brings parities to that many longs."""
    mine = F.filter(longs, lambda x, i: i % step == first)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def parity_bound(a: Column, b: Column, sizes: Column, percent: int) -> Column:
    """Sets differ in at least as many n-grams as their parities do; linked ones in a bounded share of both sizes."""
    to = F.least(F.size(a), F.size(b))
    bits = F.aggregate(F.zip_with(folded(a, to), folded(b, to), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0).cast("int"), lambda s, x: s + x.cast("int"))
    return bits * (100 + percent) <= sizes * (100 - percent)


def block_product(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of a block of columns that share one, with how many they share; bounded by sizes and parities.

    ``rows``: _column, _piece, _side, _c, _n, _known and four longs of parities.
    Rows of one side of a pair of pieces meet only those of the other; pairs
    that are both known to be linked with the same row are passed over.
    """
    rows = rows.sort_values(["_column", "_piece", "_n", "_c"], ignore_index=True)
    column = rows.groupby(["_column", "_piece"], sort=False).ngroup().to_numpy()
    c, n = rows["_c"].to_numpy(np.int64), rows["_n"].to_numpy(np.int64)
    side, known = rows["_side"].to_numpy(np.int64), rows["_known"].to_numpy(bool)
    bits = np.stack([rows[f"_p{k}"].to_numpy(np.int64) for k in range(PARITY)], 1).view(np.uint64)
    # rows of a column are sorted by size: partners that are not too large follow in a range
    high = np.searchsorted(column * (1 << 40) + n, column * (1 << 40) + n * 100 // percent, "right")
    many = high - np.arange(len(rows)) - 1
    ends = np.cumsum(many)
    out = []
    at = 0
    while at < len(rows):
        start = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, start + PAIRS, "right")))
        a = np.repeat(np.arange(at, to), many[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(ends[at:to] - many[at:to] - start, many[at:to])
        use = ~(known[a] & known[b]) & ((side[a] == 2) | (side[a] != side[b]))
        a, b = a[use], b[use]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1)
        use = differ.astype(np.int64) * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
        a, b = c[a[use]], c[b[use]]
        out.append(pd.DataFrame({"_a": np.minimum(a, b), "_b": np.maximum(a, b)}))
        at = to
    both = pd.concat(out) if out else pd.DataFrame({"_a": [], "_b": []}).astype("int64")
    return both.groupby(["_a", "_b"]).size().rename("_shared").reset_index()


def exact(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(_a, _b, _both) of the pairs that are linked: sizes, parities, and the product over all columns.

    Only sets of pairs that pass the bounds are fetched: their keys mark slots of a
    table of fixed size, rows in a marked slot are read again, and the name of the set decides.
    """
    side = lambda x: classes.select(F.col("_c").alias(x), F.col("_n").alias(f"{x}_n"), F.col("_parity").alias(f"{x}_p"))
    near = pairs.join(side("_a"), "_a").join(side("_b"), "_b").filter(
        parity_bound(F.col("_a_p"), F.col("_b_p"), F.col("_a_n") + F.col("_b_n"), percent))
    near = stage(near.select("_a", "_b", "_a_n", "_b_n"))
    needed = near.select(F.col("_a").alias("_c")).union(near.select("_b")).groupBy("_c").agg(F.count("*").alias("_uses"))
    needed = stage(needed.join(classes.select("_c", "_set", "_least"), "_c"))
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(SLOTS))
    alive = F.broadcast(needed.select(slot(F.col("_least")).alias("_slot")).distinct())
    again = docs.select(F.col(key).alias("_key"), binary_text(docs, text).alias("_text"))
    again = again.withColumn("_slot", slot(F.col("_key"))).join(alive, "_slot", "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for batch in batches:
            own = [grams(t or b"", shingle) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxh128_digest(x.tobytes()) for x in own], pa.binary()),
                 pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["_set", "_columns"])

    fetched = again.mapInArrow(run, "_set binary, _columns array<long>").join(needed, "_set")
    fetched = stage(fetched.groupBy("_c").agg(F.any_value("_columns").alias("_columns"), F.any_value("_uses").alias("_uses")))
    one = lambda x: fetched.select(F.col("_c").alias(x), F.col("_columns").alias(f"{x}_set"), F.col("_uses").alias(f"{x}_uses"))
    both = join_one(join_one(near, one("_a"), ["_a"], "_a_uses", rows_each=256), one("_b"), ["_b"], "_b_uses", rows_each=256)
    both = both.withColumn("_both", F.size(F.array_intersect("_a_set", "_b_set")).cast("long"))
    return both.filter(100 * F.col("_both") >= percent * (F.col("_a_n") + F.col("_b_n") - F.col("_both"))).select("_a", "_b", "_both")


def links(classes: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(_a, _b, _both): enough links between classes to connect all that are linked, with the n-grams they share.

    First each row meets the most central row of each of its first columns, so a
    large group of near copies costs one pair a row.  Then columns of three
    rows or more are multiplied in blocks, without pairs of rows which the
    first step has linked to the same one.  A column with many rows is cut into
    pieces, and every two of them meet in a task of their own.
    """
    cells = classes.select("_c", "_n", "_centre", F.explode("_first").alias("_column"))
    counts = stage(cells.groupBy("_column").agg(F.count("*").alias("_rows")).filter("_rows > 1"))
    met = stage(join_one(cells, counts, ["_column"], "_rows"))
    hub = met.groupBy("_column").agg(
        F.max(F.struct("_centre", "_c", "_n")).alias("_hub"), F.any_value("_rows").alias("_rows"))
    hub = stage(hub.select("_column", "_rows", F.col("_hub._c").alias("_hub"), F.col("_hub._n").alias("_hub_n")))
    star = stage(join_one(met.drop("_rows", "_centre"), hub, ["_column"], "_rows"))
    spokes = (star.filter((F.col("_c") != F.col("_hub")) & size_bound(F.col("_n"), F.col("_hub_n"), percent))
              .select(F.col("_c").alias("_a"), F.col("_hub").alias("_b")).distinct())
    tied = stage(exact(spokes, classes, docs, key, text, shingle, percent))

    joined = tied.select(F.col("_a").alias("_c"), F.col("_b").alias("_hub"), F.lit(True).alias("_tied"))
    left = star.filter((F.col("_rows") > 2) & (F.col("_c") != F.col("_hub"))).join(joined, ["_c", "_hub"], "left")
    left = stage(left.select("_column", "_c", "_n", F.coalesce("_tied", F.lit(False)).alias("_known")))
    open_ = left.groupBy("_column").agg(F.count("*").alias("_rows"), F.min("_known").alias("_all")).filter("NOT _all AND _rows > 1")
    open_ = stage(open_.select("_column", "_rows"))
    work = join_one(left, open_, ["_column"], "_rows")
    parities = classes.select("_c", *[every(F.col("_parity"), k).alias(f"_p{k}") for k in range(PARITY)])
    work = work.join(parities, "_c")
    pieces = F.ceil(F.col("_rows") / BLOCK)
    own = F.pmod(F.xxhash64("_c"), F.col("_pieces"))
    work = work.withColumn("_pieces", pieces).withColumn("_own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    work = work.withColumns({
        "_piece": low * F.col("_pieces") + high,
        "_side": F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int"))})
    total = open_.agg(F.sum(F.col("_rows") * F.ceil(F.col("_rows") / BLOCK))).first()[0] or 0
    tasks = max(1, -(-total // (16 * BLOCK)))
    work = work.withColumn("_task", F.pmod(F.xxhash64("_column", "_piece"), F.lit(tasks)))
    found = (work.select("_task", "_column", "_piece", "_side", "_c", "_n", "_known", *[f"_p{k}" for k in range(PARITY)])
             .groupBy("_task").applyInPandas(lambda rows: block_product(rows, percent), "_a long, _b long, _shared long"))
    pairs = found.groupBy("_a", "_b").agg(F.sum("_shared").alias("_shared")).select("_a", "_b")
    return tied.union(exact(pairs, classes, docs, key, text, shingle, percent))


def near_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: key, ``n_shingles``, ``component_id``.

    Texts are lower-cased (A-Z) and cut into words at white space; a document
    is the set of its word n-grams.  Two documents are linked where 100 x
    intersection >= ``percent`` x union (50 to 99); ``component_id`` is the
    smallest key reachable over links, the document's own included.

    Equal sets are one class, so copies cost no pairs.  Sets are compared by
    64-bit hashes of their n-grams.  Documents without words, NULL texts
    included, have an empty set and are linked with nothing.  NULL keys are
    passed over for the smallest unless there is no other; repeated rows each
    give a row; further columns are ignored, whatever their names; an empty
    table gives an empty one.  ``docs`` is read up to four times.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    rows = stage(sets(docs, key, text, shingle, percent))
    full = rows.filter("_n > 0")
    classes = full.groupBy("_set").agg(
        F.min("_key").alias("_least"), F.count("*").alias("_copies"), F.any_value("_n").alias("_n"),
        F.any_value("_parity").alias("_parity"), F.any_value("_first").alias("_first"), F.any_value("_centre").alias("_centre"))
    classes = stage(classes.withColumn("_c", F.monotonically_increasing_id()))
    edges = links(classes, docs, key, text, shingle, percent)
    roots = components(edges.select("_a", "_b")).withColumnRenamed("_fp", "_c")
    placed = classes.select("_c", "_set", "_least", "_copies").join(roots, "_c", "left").withColumn("_root", F.coalesce("_root", "_c"))
    least = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = stage(placed.join(least, "_root").select("_set", "_copies", "component_id"))
    linked = join_one(full.select("_key", "_set", "_n"), named, ["_set"], "_copies")
    alone = rows.filter("_n = 0").select("_key", "_n", F.col("_key").alias("component_id"))
    return linked.select("_key", "_n", "component_id").union(alone).select(
        F.col("_key").alias(key), F.col("_n").alias("n_shingles"), "component_id")
