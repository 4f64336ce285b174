"""Forecasters that need no training (MDL2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions.arrays import array_mean


def persistence(inputs: str, out_len: int) -> Column:
    """Repeats the last input."""
    return F.array_repeat(F.element_at(F.col(inputs), -1), out_len)


def seasonal_naive(inputs: str, in_len: int, out_len: int, period: int) -> Column:
    """Repeats the last season.

    A missing step falls back to the same phase of the season before, and
    finally to the mean of the window.
    """
    window = F.col(inputs)
    steps = []
    for h in range(out_len):
        first = in_len - period + h % period
        phases = [F.get(window, F.lit(i)) for i in range(first, -1, -period)]
        steps.append(F.coalesce(*phases, F.col("_window_mean")))
    return F.array(*steps)


def with_seasonal_naive(samples: DataFrame, in_len: int, out_len: int, period: int, name: str = "prediction") -> DataFrame:
    return (
        samples.withColumn("_window_mean", array_mean("inputs"))
        .withColumn(name, seasonal_naive("inputs", in_len, out_len, period))
        .drop("_window_mean")
    )


def forecast_rows(samples: DataFrame, keys, prediction: str = "prediction", target: str = "target", channel: int = 0) -> DataFrame:
    """The long forecast table: one row per step, 1-based."""
    pairs = F.arrays_zip(F.col(prediction).alias("prediction"), F.col(target).alias("target"))
    return samples.select(*keys, F.posexplode(pairs).alias("_p", "_x")).select(
        *keys, (F.col("_p") + 1).cast("int").alias("step"), F.lit(channel).alias("channel"),
        F.col("_x.prediction").alias("prediction"), F.col("_x.target").alias("target"))
