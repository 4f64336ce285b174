"""Outliers to missing, and the cleaning chain of raw sensor text (OUT1-OUT4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions.scalars import positive_or_null, strip_control, to_number
from chronoloom.operators.quantiles import exact_quantiles
from chronoloom.operators.scalers import with_stats

# Series with fewer valid values are left alone.
MIN_FOR_ZSCORE = 10
MIN_FOR_CHAIN = 10


def zscore_stats(long: DataFrame, keys: Sequence[str], value: str, sample: bool = True, tags: Sequence[str] = ("",)) -> DataFrame:
    """What :func:`zscore_outliers` compares with: ``_n``, ``_mean`` and ``_std`` per group.

    With ``tags``, of each column called ``value`` and a tag, whose names end in it.
    """
    std = F.stddev_samp if sample else F.stddev_pop
    return long.groupBy(*keys).agg(*[f for t in tags for f in (
        F.count(value + t).alias(f"_n{t}"), F.avg(value + t).alias(f"_mean{t}"), F.nullif(std(value + t), F.lit(0.0)).alias(f"_std{t}"))])


def zscore_outliers(
    long: DataFrame, keys: Sequence[str], value: str, limit, sample: bool = True, min_count: int = MIN_FOR_ZSCORE,
    beside: bool = False, tag: str = "",
) -> DataFrame:
    """OUT1 (sample deviation) and OUT3 (population): outliers become NULL.

    ``limit`` is a number or a column.  ``beside`` says that zscore_stats() are
    columns of ``long`` already, whose names, and the value's, end in ``tag``.
    """
    value, (n, mean, std) = value + tag, [c + tag for c in ("_n", "_mean", "_std")]
    limit = F.lit(float(limit)) if isinstance(limit, (int, float)) else limit
    out = long if beside else with_stats(long, zscore_stats(long, keys, value, sample), keys)
    far = (F.col(n) >= min_count) & (F.abs((F.col(value) - F.col(mean)) / F.col(std)) > limit)
    return out.withColumn(value, F.when(F.coalesce(far, F.lit(False)), None).otherwise(F.col(value))).drop(n, mean, std)


def iqr_outliers(long: DataFrame, keys: Sequence[str], value: str, factor: float = 1.5, min_count: int = 0) -> DataFrame:
    """OUT2."""
    q = exact_quantiles(long, keys, value, [0.25, 0.75], ["_q1", "_q3"])
    if min_count:
        q = with_stats(q, long.groupBy(*keys).agg(F.count(value).alias("_n")), keys).where(
            F.col("_n") >= min_count).drop("_n")
    out = with_stats(long, q, keys)
    v, width = F.col(value), F.col("_q3") - F.col("_q1")
    far = (v < F.col("_q1") - factor * width) | (v > F.col("_q3") + factor * width)
    return out.withColumn(value, F.when(F.coalesce(far, F.lit(False)), None).otherwise(v)).drop("_q1", "_q3")


def parse_sensor_text(text: Column | str) -> Column:
    """PRJ8, PRJ9, PRJ10 in one expression."""
    return positive_or_null(to_number(strip_control(text)))


def clean_values(
    long: DataFrame, config: DataFrame, keys: Sequence[str], text: str, method: str = "iqr", factor: float = 1.5,
    column: str = "indicator", value: str = "value",
) -> DataFrame:
    """OUT4: text to numbers, then outliers and range checks of configured columns.

    Only configured columns with more than ten valid values are checked; the
    factor is also the limit of the z-score method.
    """
    if method not in ("iqr", "zscore", "none"):
        raise ValueError(f"unknown outlier method {method}")
    rows = long.withColumn(value, parse_sensor_text(text))
    bounds = config.select(F.col("indicator").alias(column), "min_val", "max_val")
    rows = rows.join(bounds, column, "left").withColumn("_watched", F.col("min_val").isNotNull())
    # the check sees the watched columns only; others pass through untouched
    rows = rows.withColumn("_checked", F.when(F.col("_watched"), F.col(value)))
    counts = rows.groupBy(*keys).agg(F.count("_checked").alias("_count"))
    if method == "iqr":
        rows = iqr_outliers(rows, keys, "_checked", factor)
    elif method == "zscore":
        rows = zscore_outliers(rows, keys, "_checked", factor, sample=False, min_count=0)
    rows = with_stats(rows, counts, keys)
    kept = F.when(F.col("_checked").between(F.col("min_val"), F.col("max_val")), F.col("_checked"))
    enough = F.col("_watched") & (F.col("_count") > MIN_FOR_CHAIN)
    return rows.withColumn(value, F.when(enough, kept).otherwise(F.col(value))).drop(
        "min_val", "max_val", "_watched", "_checked", "_count")
