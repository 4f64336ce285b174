"""Forecasts of the future and evaluation across splits (SCO2, MET17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from chronoloom.operators import forecast as fc, metrics as mt, models, scalers as sc, split as sp, windows as wn


def forecast_future(
    series: DataFrame, predict: fc.Predict, keys: Sequence[str], value: str, in_len: int, out_len: int, step_us: int,
    last_pos: int, pos: str = "t_idx", ts: str = "ts",
) -> DataFrame:
    """SCO2: the last window of each series, scored, with its future timestamps."""
    last = wn.last_window(series, keys, pos, ts, value, in_len, out_len, step_us, last_pos)
    made = fc.score(last.withColumn("target", F.col("future_ts")), predict, keys, out_len)
    pairs = F.arrays_zip(F.col("target").alias("ts"), F.col("prediction").alias("value"))
    return made.select(*keys, F.inline(pairs))


def evaluate_splits(
    series: DataFrame, predict: fc.Predict, length: int, ratio: Sequence[float], in_len: int, out_len: int,
    metrics: Sequence[str] = mt.METRICS, horizons: Sequence[int] = (), node: str = "node", value: str = "value",
    null_val: float | None = None, overlap: bool = False, scale: bool = False, norm_each: bool = True, rescale: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """MET17: scores every sample of the three splits in one job.

    With ``scale`` the model sees standardised inputs; ``rescale`` says whether
    the metrics are on the original scale.  Returns the long forecast table and
    the metric table.
    """
    keys = [node] if norm_each else []
    stats = None
    rows = series
    if scale:
        stats = sc.zscore_fit(series, keys, value, sc.train_steps(length, ratio[0]))
        rows = sc.zscore_transform(series, stats, keys, value)
    rows = sp.assign_splits(rows, sp.split_bounds(length, ratio, in_len, out_len, overlap))
    samples = wn.sliding_windows(rows, ["split", node], "pos", [value], in_len, out_len)
    made = models.forecast_rows(
        fc.score(samples, predict, ["split", "sample_id", node], out_len), ["split", "sample_id", node])
    made = sc.rescale_policy(made, stats, keys, ["prediction", "target"], rescale)
    made = made if node == "node" else made.withColumnRenamed(node, "node")
    return made, mt.horizon_metrics(made, horizons, metrics, ["split"], null_val)


def metric_record(metrics: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """SNK6 layout: one nested record per split, scope to metric to value."""
    per_scope = metrics.groupBy(*by, "scope").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return per_scope.groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("scope", F.to_json("metrics").alias("m"))))).alias("scopes"))


def per_model(tables: Mapping[str, DataFrame]) -> DataFrame:
    """SET1 of per-model tables, with the model's name."""
    return sp.union_all([t.withColumn("model", F.lit(name)) for name, t in tables.items()])
