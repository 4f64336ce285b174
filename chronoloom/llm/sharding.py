"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.llm.ranks import positions
from chronoloom.session import stage


def scores(key: Column, weights: Sequence[float], seed: int = 0) -> list[Column]:
    """One score per shard: w / -ln(u), u a hash of key and shard as a number between 0 and 1."""
    def one(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.lit(float(weight)) / -F.log(u)

    return [one(s, w) for s, w in enumerate(weights)]


def best(values: Sequence[Column]) -> Column:
    """Number of the largest score, ties to the smaller number."""
    return -F.array_max(F.array(*[F.struct(v.alias("score"), F.lit(-s).alias("shard"))
                                  for s, v in enumerate(values)]))["shard"]


def rendezvous(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 24,
               next_weight: float = 1.0, seed: int = 0) -> DataFrame:
    """Each row's shard, its slot there and its shard if one more were added.

    A shard's share follows its weight.  Key and weights alone decide, so a
    new shard only takes rows into itself, and one that goes gives up only its
    own.  Columns: ``key``, ``size`` (bytes of the text and 8), ``text_crc32``,
    ``shard``, ``grown_shard``, ``slot`` (gapless from 0 in each shard; no shard
    is one task).  Equal keys share a shard, as do all NULL keys; NULL text
    counts as empty.  An empty table gives an empty table; further columns are
    ignored.
    """
    known = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(known) + 8).cast("long").alias("size"), F.crc32(known).alias("text_crc32"),
        F.array(*scores(F.coalesce(F.col(key).cast("string"), F.lit("")), [*weights, next_weight], seed)).alias("_scores"))
    old = [F.col("_scores")[s] for s in range(len(weights))]
    rows = rows.select(
        key, "size", "text_crc32", best(old).cast("int").alias("shard"),
        F.when(F.col("_scores")[len(weights)] > F.greatest(*old, F.lit(-1.0)), F.lit(len(weights))).alias("_new"))
    rows = stage(rows.withColumn("grown_shard", F.coalesce("_new", "shard").cast("int")).drop("_new"))
    return positions(rows, ["shard"], [key, "text_crc32", "size"], seed=seed).select(
        key, "size", "text_crc32", "shard", F.col("_place").cast("long").alias("slot"), "grown_shard")
