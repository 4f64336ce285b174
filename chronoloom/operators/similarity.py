"""Similarity of the nodes of each window (SIM1-SIM3).

Nodes of one window are packed into blocks of bounded size.  Two blocks meet
under the key (window, i, j) with i <= j, to which each is sent once per other
block, so a window with very many nodes is many tasks; all measures here are
symmetric, and one meeting serves both directions and all measures asked for.
SIM3 counts inside the block pair and never writes a pair out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chronoloom.session import stage

BLOCK = 256
NORM_GUARD = 1e-7


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    nx, ny = np.linalg.norm(x, axis=1) + NORM_GUARD, np.linalg.norm(y, axis=1) + NORM_GUARD
    return (x @ y.T) / np.outer(nx, ny)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - y[None, :, j]) ** 2
    return np.sqrt(total)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        total += np.abs(x[:, j, None] - y[None, :, j])
    return total


METRICS = {"cosine": cosine, "mse": euclidean, "mae": manhattan}


def _flat(column: str):
    return F.flatten(F.transform("_list", lambda r: r[column].cast("array<double>")))


def _block_pairs(samples: DataFrame, sample: Sequence[str], node: str, arrays: Sequence[str], block: int) -> DataFrame:
    nodes = samples.agg(F.count_distinct(F.struct(node))).first()[0]
    n_blocks = max(1, -(-nodes // block))
    packed = samples.withColumn("_b", F.pmod(F.xxhash64(node), F.lit(n_blocks)).cast("int")).groupBy(*sample, "_b").agg(
        F.collect_list(F.struct(F.col(node).alias("node"), *arrays)).alias("_list"))
    packed = packed.select(*sample, "_b", F.transform("_list", lambda r: r["node"]).alias("nodes"),
                           *[_flat(a).alias(a) for a in arrays])
    if n_blocks > 1:
        packed = stage(packed)  # read by both sides
    from_own = F.explode(F.sequence(F.col("_b"), F.lit(n_blocks - 1)))
    to_own = F.explode(F.sequence(F.lit(0), F.col("_b")))
    left = packed.withColumn("_j", from_own).withColumnRenamed("_b", "_i")
    right = packed.withColumn("_i", to_own).select(
        *sample, "_i", F.col("_b").alias("_j"), F.col("nodes").alias("o_nodes"), *[F.col(a).alias(f"o_{a}") for a in arrays])
    return left.join(right, [*sample, "_i", "_j"])


def _matrix(flat, count: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(count, -1)


def pairwise(
    samples: DataFrame, column: str, metric: str | Sequence[str] = "cosine", sample: Sequence[str] = ("sample_id",),
    node: str = "node", block: int = BLOCK,
) -> DataFrame:
    """SIM1, SIM2: the similarity matrix of each window, ``(sample, node, other, value)``.

    Several measures come from one pass, as columns of their names.
    """
    names = [metric] if isinstance(metric, str) else list(metric)
    for name in names:
        if name not in METRICS:
            raise NotImplementedError(name)
    values = ["value"] if isinstance(metric, str) else names
    sample = list(sample)
    fields = dict(samples.dtypes)
    schema = ", ".join([f"`{c}` {fields[c]}" for c in sample] + [
        f"node {fields[node]}, other {fields[node]}", *[f"{v} double" for v in values]])
    columns = [*sample, "node", "other", *values]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                a, b = np.asarray(r["nodes"]), np.asarray(r["o_nodes"])
                x, y = _matrix(r[column], len(a)), _matrix(r[f"o_{column}"], len(b))
                made = [METRICS[n](x, y) for n in names]
                for p, q, turn in ((a, b, False), (b, a, True))[:1 + (r["_i"] != r["_j"])]:
                    out = pd.DataFrame({"node": np.repeat(p, len(q)), "other": np.tile(q, len(p))})
                    for v, m in zip(values, made):
                        out[v] = (m.T if turn else m).ravel()
                    for c in sample:
                        out[c] = r[c]
                    yield out[columns]

    return _block_pairs(samples, sample, node, [column], block).mapInPandas(run, schema)


def indistinguishability(
    samples: DataFrame, sample: Sequence[str] = ("sample_id",), node: str = "node", upper: float = 0.9,
    lower: float = 0.4, block: int = BLOCK,
) -> DataFrame:
    """SIM3: pairs alike in the past and unlike in the future, in thousandths.

    ``overlap_ratio`` is their share of all pairs, ``indistinguishability`` their
    share of the pairs alike in the past.
    """
    sample = list(sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = past = both = 0
        for pdf in batches:
            for r in pdf.to_dict("records"):
                n, m = len(r["nodes"]), len(r["o_nodes"])
                alike = cosine(_matrix(r["inputs"], n), _matrix(r["o_inputs"], m)) > upper
                apart = cosine(_matrix(r["target"], n), _matrix(r["o_target"], m)) < lower
                times = 1 if r["_i"] == r["_j"] else 2  # both directions
                pairs += times * n * m
                past += times * int(alike.sum())
                both += times * int((alike & apart).sum())
        yield pd.DataFrame({"pairs": [pairs], "past": [past], "both": [both]})

    counts = _block_pairs(samples, sample, node, ["inputs", "target"], block).mapInPandas(
        count, "pairs long, past long, both long")
    total = counts.agg(*[F.sum(c).alias(c) for c in ("pairs", "past", "both")])
    return total.select(
        "pairs", F.col("past").alias("past_similar"), F.col("both").alias("overlap"),
        (F.col("both") / F.nullif(F.col("pairs"), F.lit(0)) * 1000).alias("overlap_ratio"),
        (F.col("both") / F.nullif(F.col("past"), F.lit(0)) * 1000).alias("indistinguishability"))
