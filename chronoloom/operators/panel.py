"""Panels: long dense series ``(node, t_idx, ts, value)`` (PRJ1-PRJ7, CAL7-CAL9)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions import calendar as cal
from chronoloom.functions.calendar import from_micros, micros
from chronoloom.operators.skew import spread
from chronoloom.operators.timeaxis import CHUNK, chunk_of
from chronoloom.session import stage


@dataclass(frozen=True)
class Axis:
    """A regular time axis."""

    start_us: int
    step_us: int
    length: int


def observed_axis(df: DataFrame, ts: str, step_us: int) -> Axis:
    """The axis that covers all observations; one small aggregate."""
    lo, hi = df.agg(F.min(micros(ts)), F.max(micros(ts))).first()
    if lo is None:
        raise ValueError("no timestamps to build an axis from")
    first, last = lo // step_us, hi // step_us
    return Axis(first * step_us, step_us, last - first + 1)


def to_panel(
    df: DataFrame, keys: Sequence[str], ts: str, value: Column, axis: Axis, name: str = "value"
) -> DataFrame:
    """Averages observations into cells and fills absent cells with NULL rows.

    The filler comes from ``sequence`` on one row per series and chunk of the
    axis, never from a product of series and timestamps.  It is dealt before it
    is unfolded, by the number of cells, so only observed cells are exchanged,
    and it meets them in an aggregation, so there is no join.
    """
    keys = list(keys)
    position = F.floor((micros(ts) - F.lit(axis.start_us)) / F.lit(axis.step_us)).cast("long")
    observed = df.select(*keys, position.alias("t_idx"), value.cast("double").alias("_v"))
    cells = observed.groupBy(*keys, "t_idx").agg(F.avg("_v").alias("_v")).select(
        *keys, chunk_of("t_idx", CHUNK).alias("_chunk"), F.array("t_idx").alias("_steps"), "_v")
    series = stage(observed.select(*keys).distinct())
    first, last = F.col("_chunk") * CHUNK, F.lit(axis.length - 1).cast("long")
    filler = series.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunk_of(last, CHUNK)))).select(
        *keys, "_chunk", F.lit(None).cast("array<bigint>").alias("_steps"), F.lit(None).cast("double").alias("_v"))
    dealt = spread(cells.unionByName(filler), series.count() * axis.length, *keys, "_chunk")
    steps = F.coalesce("_steps", F.sequence(first, F.least(first + CHUNK - 1, last)))
    dense = dealt.select(*keys, "_chunk", F.explode(steps).alias("t_idx"), "_v").groupBy(*keys, "_chunk", "t_idx").agg(F.max("_v").alias(name))
    return dense.select(*keys, "t_idx", axis_time(axis).alias("ts"), name)


def axis_time(axis: Axis, t_idx: str = "t_idx") -> Column:
    return from_micros(F.lit(axis.start_us) + F.col(t_idx) * F.lit(axis.step_us))


def select_channels(df: DataFrame, channels: Iterable[int], channel: str = "channel") -> DataFrame:
    """PRJ1."""
    return df.where(F.col(channel).isin(list(channels)))


def select_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """PRJ2, PRJ3."""
    return df.select(*keys, *features)


def select_series(df: DataFrame, nodes: Iterable | DataFrame, node: str = "node") -> DataFrame:
    """PRJ4: a list of series, or a table of them."""
    if isinstance(nodes, DataFrame):
        return df.join(nodes.select(node).distinct(), node, "left_semi")
    return df.where(F.col(node).isin(list(nodes)))


def first_steps(df: DataFrame, k: int, t_idx: str = "t_idx") -> DataFrame:
    """PRJ5: the first ``k`` steps of every series, as a pushed-down filter."""
    return df.where(F.col(t_idx) < k)


def slice_series(
    df: DataFrame, nodes: Sequence, begin: int, end: int, length: int, node: str = "node"
) -> DataFrame:
    """PRJ6: chosen series over ``[begin, end)``."""
    if not 0 <= begin < end <= length:
        raise ValueError(f"bad range [{begin}, {end}) for {length} steps")
    return df.where(F.col(node).isin(list(nodes)) & (F.col("t_idx") >= begin) & (F.col("t_idx") < end))


def hide_future(df: DataFrame, target: str = "target", training: bool = False) -> DataFrame:
    """PRJ7: outside training a model sees no future value, only its time features."""
    if training:
        return df
    return df.withColumn(target, F.transform(F.col(target), lambda x: F.lit(None).cast("double")))


def check_finite(df: DataFrame, value: str, raise_ex: bool = False) -> DataFrame:
    """PRJ15."""
    from chronoloom.functions.scalars import nan_or_inf_flags

    report = df.agg(*nan_or_inf_flags(value))
    if raise_ex:
        row = report.first()
        if row.has_nan or row.has_inf:
            raise ValueError(f"{value}: NaN {row.has_nan}, Inf {row.has_inf}")
    return report


def curriculum_length(epoch: int | None, warm_up: int, cl_epochs: int, step: int, length: int) -> int:
    """PRJ19: horizon used in ``epoch`` (1-based); the full one during warm-up."""
    if epoch is None or epoch - 1 < warm_up:
        return length
    return min(((epoch - 1 - warm_up) // cl_epochs + 1) * step, length)


def curriculum_steps(df: DataFrame, epoch: int | None, warm_up: int, cl_epochs: int, step: int, length: int,
                     step_col: str = "step") -> DataFrame:
    return df.where(F.col(step_col) <= curriculum_length(epoch, warm_up, cl_epochs, step, length))


def with_calendar(df: DataFrame, ts: str = "ts", features: Sequence[str] = ("tod", "dow", "dom", "doy")) -> DataFrame:
    """CAL1, CAL3, CAL5, CAL6 on every row.

    The features are cheap expressions of a column already present, so every
    node gets them (CAL7) without the join a shared feature table would need.
    """
    return df.withColumns({name: cal.FEATURES[name](ts) for name in features})


def with_index_calendar(df: DataFrame, steps_per_day: int, t_idx: str = "t_idx") -> DataFrame:
    """CAL2, CAL4."""
    return df.withColumns({
        "tod": cal.time_of_day_index(t_idx, steps_per_day),
        "dow": cal.day_of_week_index(t_idx, steps_per_day),
    })


def match_width(df: DataFrame, keys: Sequence[str], channels: Sequence[str], width: int) -> DataFrame:
    """PRJ18: keep the first ``width`` channels; too few is an error."""
    if len(channels) < width:
        raise ValueError(f"shape mismatch: expected {width} channels, got {len(channels)}")
    return df.select(*keys, *channels[:width])


def infer_frequency_minutes(df: DataFrame, ts: str = "ts", order: str | None = None) -> int:
    """CAL8: minutes between the first two rows.

    ``order`` is the row order of the file; without it the two smallest
    timestamps are compared, duplicates included.
    """
    by = F.col(order) if order else micros(ts)
    rows = df.where(F.col(ts).isNotNull()).orderBy(by).select(micros(ts).alias("us")).limit(2).collect()
    if len(rows) < 2:
        raise ValueError("need two timestamps to infer a frequency")
    minutes = int((rows[1].us - rows[0].us) / 60_000_000)
    if minutes <= 0:
        raise ValueError("frequency must be positive")
    return minutes


def future_timestamps(df: DataFrame, keys: Sequence[str], ts: str, step_us: int, horizon: int) -> DataFrame:
    """CAL9: ``horizon`` stamps after the last one of each series."""
    last = df.groupBy(*keys).agg(F.max(micros(ts)).alias("_last"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return (
        last.withColumn("step", steps)
        .select(*keys, "step", from_micros(F.col("_last") + F.col("step") * F.lit(step_us)).alias("ts"))
    )
