"""Filling missing values along the axis (IMP1, IMP2, IMP4, IMP5, IMP7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronoloom.functions.calendar import micros
from chronoloom.functions.scalars import clip
from chronoloom.operators.spline import BLOCK, spline_curvatures, with_curvatures, with_spline
from chronoloom.operators.timeaxis import CHUNK, valid_neighbours
from chronoloom.session import stage

MIN_FOR_SPLINE = 4
MIN_FOR_LINE = 2
NEIGHBOURS = ("prev", "next", "series_first", "series_last")


def _line(axis):
    """The straight line between the neighbours, at ``axis``."""
    span = F.nullif(F.col("next.axis") - F.col("prev.axis"), F.lit(0))
    return F.col("prev.value") + (F.col("next.value") - F.col("prev.value")) * ((axis - F.col("prev.axis")) / span)


def _neighbours(long, keys, pos, value, axis, chunk):
    work = long.withColumn("axis", axis.cast("double"))
    return valid_neighbours(work, keys, pos, value, chunk, extra=["axis"])


def interpolate_linear(long: DataFrame, keys: Sequence[str], pos: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """IMP1: by position, forward only: what precedes the first value stays missing."""
    out = _neighbours(long, keys, pos, value, F.col(pos), chunk)
    filled = F.coalesce(F.col(value), _line(F.col("axis")), F.col("prev.value"))
    return out.withColumn(value, filled).drop(*NEIGHBOURS, "axis")


def interpolate_time(
    long: DataFrame, keys: Sequence[str], pos: str, ts: str, value: str, chunk: int | None = CHUNK
) -> DataFrame:
    """IMP2: by elapsed time, in both directions; the ends take the nearest value."""
    out = _neighbours(long, keys, pos, value, micros(ts), chunk)
    filled = F.coalesce(F.col(value), _line(F.col("axis")), F.col("prev.value"), F.col("next.value"))
    return out.withColumn(value, filled).drop(*NEIGHBOURS, "axis")


def fill_both_ways(long: DataFrame, keys: Sequence[str], pos: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """IMP4: forward, then backward."""
    out = valid_neighbours(long, keys, pos, value, chunk)
    return out.withColumn(value, F.coalesce(value, "prev.value", "next.value")).drop(*NEIGHBOURS)


def fill_chain(
    long: DataFrame, config: DataFrame, keys: Sequence[str], pos: str, value: str = "value", column: str = "indicator",
    ts: str | None = None, sparse: str = "skip", chunk: int = BLOCK,
) -> DataFrame:
    """IMP3/IMP1/IMP2, then IMP4, then PRJ12, per configured column with gaps (IMP7).

    With ``ts`` the axis is elapsed time, else the position.  Series with fewer
    than two values are left alone (``sparse='skip'``) or filled without
    interpolation and without clipping (``sparse='fill'``).  ``column`` is one of
    the keys.  The input is read several times: stage it if it is costly.
    """
    if sparse not in ("skip", "fill"):
        raise ValueError(f"unknown rule {sparse}")
    axis = micros(ts) if ts else F.col(pos)
    facts = long.groupBy(*keys).agg(F.count(value).alias("_valid"), F.count_if(F.col(value).isNull()).alias("_gaps"))
    bounds = config.select(F.col("indicator").alias(column), "min_val", "max_val", "interpolation")
    facts = stage(facts.join(bounds, column, "left"))
    active = F.col("min_val").isNotNull() & (F.col("_gaps") > 0)
    cubic = facts.where(active & (F.col("interpolation") == "cubic") & (F.col("_valid") >= MIN_FOR_SPLINE))
    work = long.withColumn("axis", axis.cast("double"))
    knots, ends = spline_curvatures(work, keys, pos, "axis", value, cubic.select(*keys), chunk)
    work = with_curvatures(work, knots, keys, pos, value)
    of_series = facts.join(ends, list(keys), "left").withColumn("_cubic", F.col("_left").isNotNull())
    out = valid_neighbours(work, keys, pos, value, chunk, extra=["axis", "_m"], series=of_series)
    nearest = F.coalesce(F.col("prev.value"), F.col("next.value"))
    out = with_spline(out, "axis", value, "_spline")
    spline = F.when(F.col("_cubic"), F.col("_spline"))
    out = out.withColumn("_filled", F.coalesce(F.col(value), spline, _line(F.col("axis")), nearest))
    result = F.when(active & (F.col("_valid") >= MIN_FOR_LINE), clip("_filled", F.col("min_val"), F.col("max_val")))
    if sparse == "fill":
        result = result.when(active, F.coalesce(F.col(value), nearest))
    return out.withColumn(value, result.otherwise(F.col(value))).drop(
        *NEIGHBOURS, "axis", "_m", "_spline", "_filled", "_left", "_right", "_cubic", "_valid", "_gaps", "min_val", "max_val", "interpolation")
