"""Runs of missing values (GAP1, GAP2).

On a dense axis the run a missing step lies in is known from its nearest valid
neighbours: it reaches from just after the previous one to just before the next.
So no islands are grouped and a long series needs no single-task sort.  Where
only long runs matter, the valid rows tell them and the missing are not sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from chronoloom.operators.timeaxis import CHUNK, chunk_of, valid_neighbours

#: Steps of a piece of the axis, as a multiple of the shortest run looked for.
PIECE = 32


def with_runs(long: DataFrame, keys: Sequence[str], pos: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``run_start`` and ``run_length`` to missing rows, NULL on valid ones.

    ``pos`` must be consecutive within a series.
    """
    out = valid_neighbours(long, keys, pos, value, chunk)
    start = F.coalesce(F.col("prev.pos") + 1, F.col("series_first"))
    stop = F.coalesce(F.col("next.pos") - 1, F.col("series_last"))
    missing = F.col(value).isNull()
    return out.withColumn("run_start", F.when(missing, start)).withColumn(
        "run_length", F.when(missing, stop - start + 1)).drop("series_first", "series_last")


def missing_runs(long: DataFrame, keys: Sequence[str], pos: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """GAP1: missing share, longest and mean run, number of runs, per series."""
    rows = with_runs(long, keys, pos, value, chunk)
    head = F.col("run_start") == F.col(pos)
    length = F.when(head, F.col("run_length"))
    return rows.groupBy(*keys).agg(
        (F.count_if(F.col(value).isNull()) / F.count(F.lit(1)) * 100).alias("missing_rate"),
        F.coalesce(F.max(length), F.lit(0)).cast("long").alias("max_consecutive"),
        F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_consecutive"),
        F.count(length).alias("consecutive_gaps"))


def long_runs(long: DataFrame, keys: Sequence[str], pos: str, value: str, at_least: int, chunk: int = CHUNK) -> DataFrame:
    """``(keys, start, stop)``: the runs of at least ``at_least`` missing steps, one or more.

    A run is what lies between two valid rows, so only these are put in order;
    what reaches across the border of a chunk, and the ends of a series, follow
    from one row per chunk.  ``pos`` must be consecutive within a series.
    """
    keys = list(keys)
    named = [F.col(c).isNotNull() for c in [*keys, pos]]
    rows = long.where(reduce(and_, named)).select(*keys, F.col(pos).alias("_pos"), F.col(value).isNotNull().alias("_valid"))
    rows = rows.withColumn("_chunk", chunk_of("_pos", chunk))
    at = F.when(F.col("_valid"), F.col("_pos"))
    ends = rows.groupBy(*keys, "_chunk").agg(
        F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    along, series = Window.partitionBy(*keys).orderBy("_chunk"), Window.partitionBy(*keys)
    carried = F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumns({
        "_before": F.coalesce(carried, F.min("_lo").over(series) - 1), "_end": F.max("_hi").over(series), "_after": F.lead("_chunk").over(along)})
    run = lambda before, after: F.struct((before + 1).alias("start"), (after - 1).alias("stop"))
    tail = F.when(F.col("_after").isNull(), run(F.coalesce("_last", "_before"), F.col("_end") + 1))
    outer = ends.select(*keys, F.explode(F.array_compact(F.array(run(F.col("_before"), F.col("_first")), tail))).alias("_run"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    inner = rows.where("_valid").select(*keys, run(F.lag("_pos").over(inside), F.col("_pos")).alias("_run"))
    return outer.unionByName(inner).select(*keys, "_run.*").where(F.col("stop") - F.col("start") + 1 >= at_least)


def mark_long_gaps(
    long: DataFrame, keys: Sequence[str], station: Sequence[str], pos: str, value: str, limits: Sequence[int],
    configured: Sequence[str] | None = None, column: str = "indicator", chunk: int = CHUNK,
) -> DataFrame:
    """Adds ``_gap<limit>``: whether a step of a station lies in a run of ``limit`` or more of any configured column.

    The axis is cut into pieces of ``PIECE`` times the shortest limit.  Runs that
    meet are one, so a piece has not many more, whatever the number of columns;
    its rows look into their list.
    """
    station, size = list(station), min(CHUNK, PIECE * min(limits))
    watched = long if configured is None else long.where(F.col(column).isin(list(configured)))
    runs = long_runs(watched, keys, pos, value, min(limits), chunk)
    reached = F.filter(F.array(*[F.lit(g) for g in limits]), lambda g: g <= F.col("stop") - F.col("start") + 1)
    pieces = runs.select(*station, "start", "stop", reached.alias("_reached"), F.explode(
        F.sequence(chunk_of("start", size), chunk_of("stop", size))).alias("_piece"))
    low = F.col("_piece") * size
    pieces = pieces.select(
        *station, "_piece", F.explode("_reached").alias("_limit"), F.greatest("start", low).alias("start"),
        F.least("stop", low + size - 1).alias("stop")).repartition(*station, "_piece")
    line = Window.partitionBy(*station, "_piece", "_limit").orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    heads = pieces.withColumn("_head", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    heads = heads.withColumn("_group", F.sum("_head").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = heads.groupBy(*station, "_piece", "_limit", "_group").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    listed = merged.groupBy(*station, "_piece").agg(*[
        F.collect_list(F.when(F.col("_limit") == g, F.struct("start", "stop"))).alias(f"_gap{g}") for g in limits])
    # the lists are few and short; the rows, dealt by piece, need no order to meet them
    out = long.withColumn("_piece", chunk_of(pos, size)).join(listed.hint("shuffle_hash"), [*station, "_piece"], "left")
    inside = lambda g: F.exists(f"_gap{g}", lambda r: (F.col(pos) >= r["start"]) & (F.col(pos) <= r["stop"]))
    return out.withColumns({f"_gap{g}": F.coalesce(inside(g), F.lit(False)) for g in limits}).drop("_piece")


def longest_gaps(
    long: DataFrame, keys: Sequence[str], station: Sequence[str], pos: str, value: str, chunk: int = CHUNK
) -> DataFrame:
    """Per step of a station, the longest run it lies in among its series: ``(station, pos, longest)``."""
    rows = with_runs(long, keys, pos, value, chunk)
    return rows.groupBy(*station, pos).agg(F.coalesce(F.max("run_length"), F.lit(0)).alias("longest"))


def drop_long_gaps(
    long: DataFrame, keys: Sequence[str], station: Sequence[str], pos: str, value: str, max_gap: int,
    configured: Sequence[str] | None = None, column: str = "indicator", chunk: int = CHUNK,
) -> DataFrame:
    """GAP2: removes every step of a station that lies in a long run of any configured column."""
    if max_gap < 1:  # no run is that short: every step counts
        watched = long if configured is None else long.where(F.col(column).isin(list(configured)))
        return long.join(longest_gaps(watched, keys, station, pos, value, chunk), [*station, pos], "left_anti")
    marked = mark_long_gaps(long, keys, station, pos, value, [max_gap], configured, column, chunk)
    return marked.where(~F.col(f"_gap{max_gap}")).select(*long.columns)
