"""Chronological splits and sets of rows (SPL2-SPL5, SET1-SET3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPLITS = ("train", "valid", "test")


def split_sizes(length: int, ratio: Sequence[float]) -> dict[str, int]:
    """SPL2: validation and test are rounded down, training takes the rest."""
    valid, test = int(length * ratio[1]), int(length * ratio[2])
    return {"train": length - valid - test, "valid": valid, "test": test}


def split_bounds(
    length: int, ratio: Sequence[float], in_len: int, out_len: int, overlap: bool = False
) -> dict[str, tuple[int, int]]:
    """SPL2-SPL4: half-open ``[lo, hi)`` of each split.

    A split too short for a single sample is widened even where ``overlap`` is
    off; the others are left alone.
    """
    size = split_sizes(length, ratio)
    lo = {"train": 0, "valid": size["train"], "test": size["train"] + size["valid"]}
    out = {}
    for name in SPLITS:
        first, last = lo[name], lo[name] + size[name]
        if overlap or in_len + out_len > size[name]:
            if name != "train":
                first -= in_len - 1
            if name != "test":
                last += out_len
        out[name] = (max(first, 0), min(last, length))
    return out


def sample_count(length: int, in_len: int, out_len: int) -> int:
    """SPL5."""
    return max(length - in_len - out_len + 1, 0)


def bounds_table(spark: SparkSession, bounds: Mapping[str, tuple[int, int]], in_len: int, out_len: int) -> DataFrame:
    rows = [(k, lo, hi, sample_count(hi - lo, in_len, out_len)) for k, (lo, hi) in bounds.items()]
    return spark.createDataFrame(rows, "split string, lo long, hi long, samples long")


def split_labels(t_idx: str, bounds: Mapping[str, tuple[int, int]]) -> Column:
    """The splits a step belongs to; with overlap there can be two."""
    t = F.col(t_idx)
    labels = [
        F.when((t >= lo) & (t < hi), F.struct(F.lit(name).alias("split"), F.lit(lo).cast("long").alias("lo")))
        for name, (lo, hi) in bounds.items()
    ]
    return F.array_compact(F.array(*labels))


def assign_splits(df: DataFrame, bounds: Mapping[str, tuple[int, int]], t_idx: str = "t_idx") -> DataFrame:
    """SPL2/SPL3 on rows: adds ``split`` and ``pos``, the step inside the split.

    The three bounds are literals of a map-side expression: no join, and a row
    in two splits is emitted twice.
    """
    cols = [F.col(c) for c in df.columns]
    return df.select(*cols, F.inline(split_labels(t_idx, bounds))).withColumn("pos", F.col(t_idx) - F.col("lo")).drop("lo")


def one_split(df: DataFrame, bounds: Mapping[str, tuple[int, int]], name: str, t_idx: str = "t_idx") -> DataFrame:
    """One split as a range filter that reaches the Parquet scan."""
    lo, hi = bounds[name]
    return df.where((F.col(t_idx) >= lo) & (F.col(t_idx) < hi))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """SET1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without_rows(df: DataFrame, marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET2."""
    return df.join(marked.select(*keys).distinct(), list(keys), "left_anti")


def parameter_grid(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """SET3: every combination of a parameter grid, numbered in grid order.

    One ``explode`` per parameter on a single row; the first parameter varies
    slowest.
    """
    out = spark.range(1).select(F.lit(0).cast("long").alias("combination"))
    for name, values in grid.items():
        listed = F.array(*[F.lit(v) for v in values])
        width = len(values)
        out = out.select("*", F.posexplode(listed).alias("_i", name)).withColumn(
            "combination", F.col("combination") * width + F.col("_i")).drop("_i")
    return out
