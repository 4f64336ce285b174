"""Whole cleaning jobs over many stations at once (PIPE2-PIPE4).

All work is keyed by station, so a hundred sensor files are one job, and a
strategy is a column, so every strategy on every station is still one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from chronoloom import settings
from chronoloom.functions.scalars import round_to
from chronoloom.operators import gaps, impute, knn, outliers, profile as pf
from chronoloom.operators.timeaxis import reindex, running_counts
from chronoloom.session import stage


def round_indicators(long: DataFrame, config: DataFrame, value: str = "value", default: int | None = None) -> DataFrame:
    """PRJ13: decimals per indicator; others keep their digits unless a default is given."""
    digits = config.select("indicator", "decimals")
    rows = long.join(digits, "indicator", "left")
    scale = F.coalesce(F.col("decimals"), F.lit(default).cast("int")) if default is not None else F.col("decimals")
    out = F.when(scale.isNull(), F.col(value)).otherwise(round_to(value, scale))
    return rows.withColumn(value, out).drop("decimals")


def remove_outliers(kept: DataFrame, config_names: Sequence[str], keys: Sequence[str], z_limit) -> DataFrame:
    """OUT1 per series, and consecutive positions ``pos`` over the rows left.

    Statistics come to the rows with the offsets of their chunk, so rows are
    dealt once.  Later steps read them more than once, so they are staged.
    """
    series = [*keys, "indicator"]
    watched = F.col("indicator").isin(list(config_names))
    checked = kept.withColumn("_checked", F.when(watched, F.col("value")))
    stats = outliers.zscore_stats(checked, series, "_checked")
    checked = reindex(kept, series, "t_idx", "pos", series=stats).withColumn("_checked", F.when(watched, F.col("value")))
    checked = outliers.zscore_outliers(checked, series, "_checked", z_limit, beside=True)
    return stage(checked.withColumn("value", F.when(watched, F.col("_checked")).otherwise(F.col("value"))).drop("_checked"))


def remove_outliers_beside(marked: DataFrame, config_names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """remove_outliers() of every strategy: ``pos_<strategy>``, NULL where its gaps remove the row, and ``value_<strategy>``.

    ``marked`` comes from :func:`mark_strategies`.  A row is dealt, put in order
    and written once, not once per strategy that keeps it.
    """
    series = [*keys, "indicator"]
    watched = F.col("indicator").isin(list(config_names))
    limits = {n: z for n, _, z, _ in settings.STRATEGIES}
    stays = {n: ~F.col(f"_gap{g}") for n, g, _, _ in settings.STRATEGIES}
    marked = marked.where(reduce(or_, stays.values()))
    checked = lambda rows: rows.withColumns({f"_checked_{n}": F.when(stays[n] & watched, F.col("value")) for n in limits})
    stats = outliers.zscore_stats(checked(marked), series, "_checked", tags=[f"_{n}" for n in limits])
    rows = checked(running_counts(marked, series, "t_idx", {f"pos_{n}": s for n, s in stays.items()}, series=stats))
    for n, limit in limits.items():
        rows = outliers.zscore_outliers(rows, series, "_checked", limit, beside=True, tag=f"_{n}")
    value = lambda n: F.when(watched, F.col(f"_checked_{n}")).otherwise(F.when(stays[n], F.col("value")))
    return stage(rows.select(*series, "t_idx", *[c for n in limits for c in (
        F.when(stays[n], F.col(f"pos_{n}") - 1).alias(f"pos_{n}"), value(n).alias(f"value_{n}"))]))


def of_strategies(beside: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The rows of remove_outliers_beside() that these strategies keep, each in a row of its own."""
    return reduce(DataFrame.unionByName, [beside.where(F.col(f"pos_{n}").isNotNull()).select(
        F.lit(n).alias("strategy"), *keys, "t_idx", "indicator", F.col(f"pos_{n}").alias("pos"), F.col(f"value_{n}").alias("value")) for n in names])


def fill_by_neighbours(rows: DataFrame, names: Sequence[str], keys: Sequence[str], k: int = 5) -> DataFrame:
    """IMP6 on the configured indicators of a long table."""
    # dealt by step as narrow rows, which one aggregation then makes wide
    wide = stage(rows.repartition(*keys, "t_idx").groupBy(*keys, "t_idx", "pos").agg(*[
        F.first(F.when(F.col("indicator") == n, F.col("value")), True).alias(n) for n in names]))
    filled = knn.knn_impute(wide, keys, "pos", list(names), k)
    back = filled.unpivot([*keys, "t_idx", "pos"], list(names), "indicator", "value")
    others = rows.where(~F.col("indicator").isin(list(names))).select(*back.columns)
    return back.unionByName(others)


def clean_stations(long: DataFrame, config: DataFrame, strategy: str, keys: Sequence[str] = ("station",)) -> DataFrame:
    """PIPE2 on a dense long table ``(station, t_idx, indicator, value)``.

    ``segmented`` interpolates, the other strategies use nearest neighbours;
    only interpolation clips to the physical range.
    """
    keys = list(keys)
    max_gap, z_limit = settings.strategy(strategy)
    names = [r.indicator for r in config.select("indicator").orderBy("indicator").collect()]
    long = long.select(*keys, "t_idx", "indicator", "value")  # nothing else is carried from step to step
    kept = stage(gaps.drop_long_gaps(long, [*keys, "indicator"], keys, "t_idx", "value", max_gap, names))
    rows = remove_outliers(kept, names, keys, z_limit)
    if strategy == "segmented":
        rows = impute.fill_chain(rows, config, [*keys, "indicator"], "pos")
    else:
        rows = fill_by_neighbours(rows, names, keys)
    return round_indicators(rows.select(*keys, "t_idx", "pos", "indicator", "value"), config)


def cleaning_report(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """GAP1 averages before, PR4 after: one row per station."""
    keys = list(keys)
    first = gaps.missing_runs(before, [*keys, "indicator"], "t_idx", "value").groupBy(*keys).agg(
        F.avg("missing_rate").alias("missing_before"), F.max("max_consecutive").alias("longest_gap"))
    share = after.groupBy(*keys, "indicator").agg(
        (F.count_if(F.col("value").isNull()) / F.count(F.lit(1)) * 100).alias("_rate"))
    last = share.groupBy(*keys).agg(F.avg("_rate").alias("missing_after"))
    steps = pf.retention(_steps(before, keys), _steps(after, keys), keys)
    return first.join(steps, keys).join(last, keys, "left")


def _steps(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.select(*keys, "t_idx").distinct()


def enhanced_cleaning(
    long: DataFrame, config: DataFrame, keys: Sequence[str] = ("station",), text: str = "raw", ts: str = "ts",
    method: str = "iqr", factor: float = 1.5,
) -> DataFrame:
    """PIPE3: OUT4, then IMP7 by elapsed time, then rounding with four decimals for the rest."""
    series = [*keys, "indicator"]
    rows = stage(outliers.clean_values(long, config, series, text, method, factor))
    rows = impute.fill_chain(rows, config, series, "t_idx", ts=ts, sparse="fill")
    return round_indicators(rows, config, default=settings.DEFAULT_DECIMALS)


def strategies_without_gaps(long: DataFrame, names: Sequence[str], keys: Sequence[str] = ("station",)) -> DataFrame:
    """GAP2 for all strategies: rows once per strategy that keeps them, with its z-score limit."""
    return strategies_kept(mark_strategies(long, names, keys), long.columns)


def mark_strategies(long: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The runs are found once; what a strategy removes is a comparison."""
    return gaps.mark_long_gaps(
        long, [*keys, "indicator"], keys, "t_idx", "value", sorted({g for _, g, _, _ in settings.STRATEGIES}), names)


def strategies_kept(marked: DataFrame, columns: Sequence[str]) -> DataFrame:
    kept = F.array_compact(F.array(*[
        F.when(~F.col(f"_gap{g}"), F.struct(F.lit(n).alias("strategy"), F.lit(z).alias("z_limit")))
        for n, g, z, _ in settings.STRATEGIES]))
    return marked.select(*columns, F.inline(kept))


def batch_clean(long: DataFrame, config: DataFrame, keys: Sequence[str] = ("station",)) -> tuple[DataFrame, DataFrame]:
    """PIPE4: every strategy on every station; cleaned rows and the status report.

    Strategies stand beside each other in a row for as long as they share its
    place; only what fills the gaps tells them apart.
    """
    names = [r.indicator for r in config.select("indicator").orderBy("indicator").collect()]
    long = long.select(*keys, "t_idx", "indicator", "value")
    marked = stage(mark_strategies(long, names, keys))
    report = batch_report(long, strategies_kept(marked, long.columns), keys)
    rows = remove_outliers_beside(marked, names, keys)
    line = impute.fill_chain(of_strategies(rows, keys, ["segmented"]), config, [*keys, "indicator"], "pos")
    # the station comes first: keys that tell rows apart sort faster
    others = [n for n, *_ in settings.STRATEGIES if n != "segmented"]
    near = fill_by_neighbours(of_strategies(rows, keys, others), names, [*keys, "strategy"])
    columns = ["strategy", *keys, "t_idx", "pos", "indicator", "value"]
    return round_indicators(line.select(*columns).unionByName(near.select(*columns)), config), report


def batch_report(long: DataFrame, kept: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """PIPE4's status per strategy and station; a station that loses every row is ``empty``."""
    names = F.array(*[F.lit(s[0]) for s in settings.STRATEGIES])
    before = _steps(long, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before")).select(
        F.explode(names).alias("strategy"), *keys, "rows_before")
    after = _steps(kept, ["strategy", *keys]).groupBy("strategy", *keys).agg(F.count(F.lit(1)).alias("rows_after"))
    out = before.join(after, ["strategy", *keys], "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    return out.withColumn("retention_pct", F.col("rows_after") / F.col("rows_before") * 100).withColumn(
        "status", F.when(F.col("rows_after") > 0, F.lit("success")).otherwise(F.lit("empty")))
