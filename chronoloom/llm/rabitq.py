"""Nearest neighbours by randomly rotated one-bit codes with error bounds, and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoloom.session import stage

#: Vectors and queries that meet in one task; estimates held at once in it.
BLOCK, QUERIES, HELD = 16_384, 4_096, 1 << 21
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 3.0


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors at unit length.  Divided by the largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and the inner product of each with its code."""
    turned = unit(vectors) @ rotation(vectors.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, all components finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", seed: int = 0) -> DataFrame:
    """Every usable row with its code: (_id, _dim, _vector, _code, _fit).

    Vectors that are NULL, zero or hold NULL or non-finite components take no
    part; any other does, however large or small.  Of rows with the same key
    the smallest vector stays; NULL keys take no part.
    """
    rows = vectors.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_vector"))
    rows = rows.filter(F.col("_id").isNotNull() & usable(F.col("_vector"))).groupBy("_id").agg(F.min("_vector").alias("_vector"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, rows in part.groupby(part["_vector"].map(len)):
                code, fit = encode(np.stack(rows["_vector"].to_numpy()), seed)
                yield pd.DataFrame({"_id": rows["_id"], "_dim": dim, "_vector": rows["_vector"],
                                    "_code": [c.tobytes() for c in code], "_fit": fit})

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"_id {kind}, _dim int, _vector array<double>, _code binary, _fit double")


def best_of(found: pd.DataFrame, asked: pd.DataFrame, k: int, seed: int, width: float) -> pd.DataFrame:
    """The k nearest of one block for each query: estimates for all, exact products where the bound allows a place."""
    empty = pd.DataFrame({"_query": [], "_id": [], "_score": []}).astype({"_query": "int64", "_id": "int64", "_score": float})
    if not len(found) or not len(asked):
        return empty
    ids, x = found["_id"].to_numpy(), np.stack(found["_vector"].to_numpy())
    dim = x.shape[1]
    x = x / np.abs(x).max(1, keepdims=True)  # cosines are the same, and no square overflows or vanishes
    norms = np.sqrt((x * x).sum(1))
    bits = np.unpackbits(np.frombuffer(b"".join(found["_code"]), np.uint8).reshape(len(found), -1), axis=1, count=dim)
    signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    fit = found["_fit"].to_numpy()
    error = width * np.sqrt(np.maximum(0, 1 - fit ** 2)) / fit / np.sqrt(max(1, dim - 1))
    qids, q = asked["_id"].to_numpy(), np.stack(asked["_vector"].to_numpy())
    q = q / np.abs(q).max(1, keepdims=True)
    qnorms = np.sqrt((q * q).sum(1))
    turned = ((q / qnorms[:, None]) @ rotation(dim, seed).T).astype(np.float32)
    out = []
    chunk = max(1, HELD // len(ids))
    for at in range(0, len(qids), chunk):
        estimate = turned[at:at + chunk] @ signs.T / fit
        low = estimate - error
        low[qids[at:at + chunk, None] == ids[None]] = -np.inf
        rank = min(k, len(ids)) - 1
        bar = -np.partition(-low, rank, axis=1)[:, rank]
        for row, (own, vec, norm) in enumerate(zip(qids[at:at + chunk], q[at:at + chunk], qnorms[at:at + chunk])):
            near = np.flatnonzero((estimate[row] + error >= bar[row]) & (ids != own))
            exact = (x[near] * vec).sum(1) / (norms[near] * norm)
            order = np.lexsort((ids[near], -exact))[:k]
            out.append(pd.DataFrame({"_query": own, "_id": ids[near][order], "_score": exact[order]}))
    return pd.concat(out) if out else empty


def nearest(codes: DataFrame, queries: DataFrame, k: int = 5, seed: int = 0, width: float = WIDTH,
            block: int = BLOCK, asked: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest cosines among the indexed rows but itself.

    Both are of the form of index().  All rows are met in blocks: rows and
    queries are dealt to blocks of bounded size by hash, each pair of blocks is
    a task's group, and only k rows per query leave it.  Vectors of another
    length than the query's are no candidates.  Ties go to the smaller id.
    """
    n = codes.count()
    m = queries.count()
    cols, rows = max(1, -(-n // block)), max(1, -(-m // asked))
    deal = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), "_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = codes.withColumn("_col", deal(cols, 1)).withColumn("_row", every(rows)).groupBy("_dim", "_col", "_row")
    right = queries.withColumn("_row", deal(rows, 2)).withColumn("_col", every(cols)).groupBy("_dim", "_col", "_row")
    found = left.cogroup(right).applyInPandas(
        lambda a, b: best_of(a, b, k, seed, width), "_query long, _id long, _score double")
    window = Window.partitionBy("_query").orderBy(F.desc("_score"), "_id")
    ranked = found.withColumn("rank", F.row_number().over(window))
    return ranked.filter(F.col("rank") <= k).select(
        F.col("_query").alias("query_id"), "rank", F.col("_id").alias("vec_id"), F.col("_score").alias("score"))


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           seed: int = 0, width: float = WIDTH) -> DataFrame:
    """Indexes all rows and asks for those that ``is_query`` (of ``_id``) marks."""
    codes = stage(index(vectors, key, vector, seed))
    return nearest(codes, codes.filter(is_query), k, seed, width)
