"""Scaling and reversible transforms (SCL1-SCL14)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions.scalars import finite_or_null, log1p_clamped
from chronoloom.operators.quantiles import exact_quantiles
from chronoloom.session import stage

# Columns that are never transformed, and the long-tailed
# indicators that get a logarithm by default.
TIME_COLUMNS = ("date", "timestamp", "time", "datetime")
LOG_COLUMNS = ("ammonia_nitrogen", "total_phosphorus", "turbidity", "permanganate_index")
#: Groups whose statistics are broadcast at most.
FEW = 10_000


def train_steps(length: int, train_ratio: float) -> int:
    """Steps a scaler is fitted on; may differ from the training split by a step or two."""
    return int(length * train_ratio)


def with_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Puts one statistics row per group next to its rows.

    No broadcast hint: the number of groups grows with the data, and adaptive
    execution broadcasts the statistics where they are small.  A single row of
    global statistics is joined on a constant.
    """
    if keys:
        return df.join(stats, list(keys), "left")
    one = stats.withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(one, "_one", "left").drop("_one")


def beside_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """with_stats() for groups that may be few and hold millions of rows each, such as the columns of a table.

    Rows dealt by such a key would meet in one task per group.  The statistics
    are computed here, and broadcast where there are at most ``FEW`` groups;
    more are left to with_stats().
    """
    if not keys:
        return with_stats(df, stats, keys)
    stats = stage(stats)
    return with_stats(df, F.broadcast(stats) if stats.count() <= FEW else stats, keys)


def zscore_fit(df: DataFrame, keys: Sequence[str], value: str, steps: int, pos: str = "t_idx") -> DataFrame:
    """SCL1/SCL5: mean and population deviation of the first ``steps``; no keys, global."""
    std = F.stddev_pop(value)
    return df.where(F.col(pos) < steps).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))


def zscore_transform(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """SCL2."""
    out = with_stats(df, stats, keys)
    return out.withColumn(name or value, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def zscore_inverse(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    out = with_stats(df, stats, keys)
    return out.withColumn(name or value, F.col(value) * F.col("std") + F.col("mean")).drop("mean", "std")


def minmax_fit(df: DataFrame, keys: Sequence[str], value: str, steps: int, pos: str = "t_idx") -> DataFrame:
    """SCL3."""
    return df.where(F.col(pos) < steps).groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def minmax_transform(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """SCL4: a constant series has no scale, so its values become NULL."""
    out = with_stats(df, stats, keys)
    width = F.nullif(F.col("max") - F.col("min"), F.lit(0.0))
    return out.withColumn(name or value, (F.col(value) - F.col("min")) / width).drop("min", "max")


def minmax_inverse(df: DataFrame, stats: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    out = with_stats(df, stats, keys)
    return out.withColumn(
        name or value, F.col(value) * (F.col("max") - F.col("min")) + F.col("min")).drop("min", "max")


def rescale_policy(
    df: DataFrame, stats: DataFrame | None, keys: Sequence[str], columns: Sequence[str], rescale: bool
) -> DataFrame:
    """SCL6: scaled columns to the scale the metrics are computed on.

    With ``rescale`` the columns return to the original scale; without it they
    stay scaled.  ``<column>_unnorm`` is on the original scale either way, and
    equals the column where no scaler was fitted.
    """
    if stats is None:
        return df.withColumns({f"{c}_unnorm": F.col(c) for c in columns})
    out = with_stats(df, stats, keys)
    original = {c: F.col(c) * F.col("std") + F.col("mean") for c in columns}
    out = out.withColumns({f"{c}_unnorm": x for c, x in original.items()})
    if rescale:
        out = out.withColumns({c: F.col(f"{c}_unnorm") for c in columns})
    return out.drop("mean", "std")


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keys, column, value)`` rows, so that all columns share each job."""
    listed = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(*keys, *listed).unpivot(list(keys), list(columns), "column", "value")


def to_wide(df: DataFrame, keys: Sequence[str], columns: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).pivot("column", list(columns)).agg(F.first(value))


def winsorize(df: DataFrame, keys: Sequence[str], value: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """SCL7: clips to the two quantiles; infinities are missing first."""
    clean = df.withColumn(value, finite_or_null(value))
    cuts = exact_quantiles(clean, keys, value, [lower, upper], ["q01", "q99"])
    return clip_to(beside_stats(clean, cuts, keys), value, "q01", "q99")


def clip_to(df: DataFrame, value: str, lo: str, hi: str) -> DataFrame:
    v = F.col(value)
    return df.withColumn(value, F.when(v < F.col(lo), F.col(lo)).when(v > F.col(hi), F.col(hi)).otherwise(v))


def robust_fit(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """SCL9 statistics: median and IQR, with the sample deviation and then 1 as stand-ins."""
    q = exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["_q1", "median", "_q3"])
    spread = df.groupBy(*keys).agg(F.stddev_samp(value).alias("_std"))
    out = with_stats(q, spread, keys)
    iqr = F.col("_q3") - F.col("_q1")
    fallback = F.when(F.col("_std") != 0, F.col("_std")).otherwise(F.lit(1.0))
    return out.select(*keys, "median", F.when(iqr != 0, iqr).otherwise(fallback).alias("iqr"))


def robust_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """SCL9."""
    out = beside_stats(df, robust_fit(df, keys, value), keys)
    return out.withColumn(value, (F.col(value) - F.col("median")) / F.col("iqr"))


def minmax_column(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """SCL10: to [0, 1]; a constant column becomes 0."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    out = beside_stats(df, stats, keys)
    width = F.col("max") - F.col("min")
    return out.withColumn(
        value, F.when(width == 0, F.col(value) * 0.0).otherwise((F.col(value) - F.col("min")) / width))


def fit_chain(
    df: DataFrame, keys: Sequence[str], value: str, log_columns: Sequence[str] = LOG_COLUMNS, standardize: bool = True,
    rescale_minmax: bool = False, column: str = "column",
) -> DataFrame:
    """SCL7-SCL11: one metadata row per group of a long table.

    Each step's statistics depend on the step before, so there is one pass per
    step for all groups together, not one per column.
    """
    clean = df.withColumn(value, finite_or_null(value))
    cuts = exact_quantiles(clean, keys, value, [0.01, 0.99], ["q01", "q99"])
    # a row per group, read by every later step: written once instead of refitted
    meta = stage(cuts.withColumn("log1p", F.col(column).isin(list(log_columns)) if log_columns else F.lit(False)))
    if not standardize and not rescale_minmax:
        return meta
    logged = _clip_and_log(beside_stats(clean, meta, keys), value)
    if standardize:
        meta = with_stats(meta, robust_fit(logged, keys, value), keys)
    if rescale_minmax:
        ends = logged.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        meta = with_stats(meta, ends, keys)
        if standardize:
            scale = {n: (F.col(s) - F.col("median")) / F.col("iqr") for n, s in (("min", "_lo"), ("max", "_hi"))}
        else:
            scale = {"min": F.col("_lo"), "max": F.col("_hi")}
        meta = meta.withColumns(scale).drop("_lo", "_hi")
    return stage(meta)


def _clip_and_log(df: DataFrame, value: str) -> DataFrame:
    out = clip_to(df, value, "q01", "q99")
    return out.withColumn(value, F.when(F.col("log1p"), log1p_clamped(value)).otherwise(F.col(value)))


def apply_chain(df: DataFrame, meta: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """SCL11 with fitted metadata."""
    clean = df.withColumn(value, finite_or_null(value))
    out = _clip_and_log(beside_stats(clean, meta, keys), value)
    if "median" in meta.columns:
        out = out.withColumn(value, (F.col(value) - F.col("median")) / F.col("iqr"))
    if "min" in meta.columns:
        width = F.col("max") - F.col("min")
        out = out.withColumn(
            value, F.when(width == 0, F.col(value) * 0.0).otherwise((F.col(value) - F.col("min")) / width))
    return out.drop(*[c for c in meta.columns if c not in keys])


def invert_chain(df: DataFrame, meta: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """SCL12: back to the winsorised scale; clipping itself cannot be undone."""
    out = beside_stats(df, meta, keys)
    v = F.col(value)
    if "min" in meta.columns:
        v = v * (F.col("max") - F.col("min")) + F.col("min")
    if "median" in meta.columns:
        v = v * F.when(F.col("iqr") != 0, F.col("iqr")).otherwise(F.lit(1.0)) + F.col("median")
    v = F.when(F.col("log1p"), F.expm1(v)).otherwise(v)
    known = F.col("log1p").isNotNull()
    return out.withColumn(value, F.when(known, v).otherwise(F.col(value))).drop(
        *[c for c in meta.columns if c not in keys])


def chain_datasets(datasets: dict[str, DataFrame], columns: Sequence[str], row: str) -> DataFrame:
    """SCL13: several inputs as one long table keyed by ``dataset`` and ``row``, the column that names their rows."""
    longs = [
        to_long(d.withColumn("dataset", F.lit(name)).withColumn("row", F.col(row)), ["dataset", "row"], [c for c in columns if c in d.columns])
        for name, d in datasets.items()
    ]
    return reduce(DataFrame.unionByName, longs)


def paired(inputs: Sequence, outputs: Sequence) -> list[tuple]:
    """SCL13: input and output lists must match."""
    if len(inputs) != len(outputs):
        raise ValueError(f"{len(inputs)} inputs but {len(outputs)} outputs")
    return list(zip(inputs, outputs))


def standardise(df: DataFrame, keys: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """SCL14: scaled rows and the statistics to invert them; missing values stay."""
    std = F.stddev_pop(value)
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))
    return zscore_transform(df, stats, keys, value), stats


