"""Metrics and evaluation tables as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import evaluate as ev, metrics as mt
from chronoloom.plans.catalog import FORECAST_SQL, query, r6, sql_r6, user_forecast, user_predictions

MASK = "target IS NOT NULL AND abs(target - 0) > {tol}"


def _element(name: str, mask: str, error: str, outer: str = "{}") -> str:
    mean = f"coalesce(sum(CASE WHEN {mask} THEN coalesce({error}, 0) END) / nullif(count(*) FILTER (WHERE {mask}), 0), 0)"
    return f"WITH {FORECAST_SQL} SELECT split, {sql_r6(outer.format(mean))} AS {name} FROM forecast GROUP BY split"


M = MASK.format(tol=5e-5)
MZ = M + " AND abs(target) > 5e-5"
ZP = f"CASE WHEN {M} THEN coalesce(prediction, 0) ELSE 0 END"
ZT = f"CASE WHEN {M} THEN target ELSE 0 END"

SQL = {
    "mae": _element("mae", M, "abs(prediction - target)"),
    "mse": _element("mse", M, "(prediction - target) * (prediction - target)"),
    "rmse": _element("rmse", M, "(prediction - target) * (prediction - target)", "sqrt({})"),
    "mape": _element("mape", MZ, "abs((prediction - target) / target)"),
    "smape": _element("smape", MZ, "abs(prediction - target) / ((abs(prediction) + abs(target)) / 2)"),
    "huber": f"""WITH {FORECAST_SQL}, e AS (SELECT split, abs({ZP} - {ZT}) AS e FROM forecast)
SELECT split, {sql_r6('avg(CASE WHEN e <= 1 THEN 0.5 * e * e ELSE e - 0.5 END)')} AS huber FROM e GROUP BY split""",
    "wape": f"""WITH {FORECAST_SQL}, g AS (SELECT split, node, sample_id,
 sum(abs({ZP} - {ZT})) / (sum(abs({ZT})) + 5e-5) AS x FROM forecast GROUP BY split, node, sample_id)
SELECT split, {sql_r6('avg(x)')} AS wape FROM g GROUP BY split""",
    "r2": f"""WITH {FORECAST_SQL}, g AS (SELECT split, node, sample_id,
 1 - sum(({ZT} - {ZP}) * ({ZT} - {ZP})) / (var_pop({ZT}) * count(*) + 5e-5) AS x FROM forecast GROUP BY split, node, sample_id)
SELECT split, {sql_r6('avg(x)', 4)} AS r2 FROM g GROUP BY split""",
    "corr": f"""WITH {FORECAST_SQL}, g AS (SELECT split, node, sample_id, count(*) FILTER (WHERE {M}) AS n,
 CASE WHEN count(*) = count(prediction) AND count(*) = count(target) AND var_pop(prediction) > 0 AND var_pop(target) > 0
      THEN covar_pop(prediction, target) / sqrt(var_pop(prediction) * var_pop(target)) ELSE 0 END AS x
 FROM forecast GROUP BY split, node, sample_id)
SELECT split, {sql_r6('sum(x * n) / sum(n)')} AS corr FROM g GROUP BY split""",
}
NAMES = {"mae": "MAE", "mse": "MSE", "rmse": "RMSE", "mape": "MAPE", "smape": "SMAPE", "huber": "Huber",
         "wape": "WAPE", "r2": "R2", "corr": "CORR"}


def _register(short: str, metric: str) -> None:
    digits = 4 if short == "r2" else 6

    def run(spark, sf_dir):
        if metric in mt.GROUP_METRICS:  # folded inside each sample
            out = mt.evaluate_samples(user_predictions(spark, sf_dir), [metric], ["split"], null_val=0.0)
        else:
            out = mt.evaluate(user_forecast(spark, sf_dir), [metric], ["split"], null_val=0.0)
        return out.select("split", r6(metric, digits).alias(short))

    run.__doc__ = f"{metric} of the seasonal-naive forecast per split."
    query(SQL[short], f"metric_{short}")(run)


for _short, _metric in NAMES.items():
    _register(_short, _metric)


@query(f"""WITH {FORECAST_SQL}
SELECT split, CASE WHEN grouping(step) = 1 THEN 'overall' ELSE 'horizon_' || step END AS scope,
 {sql_r6(f'sum(CASE WHEN {M} THEN coalesce(abs(prediction - target), 0) END) / count(*) FILTER (WHERE {M})')} AS value, 'MAE' AS metric
FROM forecast GROUP BY GROUPING SETS ((split), (split, step))
UNION ALL
SELECT split, scope, {sql_r6('avg(x)')} AS value, 'WAPE' AS metric FROM (
 SELECT split, 'overall' AS scope, sum(abs({ZP} - {ZT})) / (sum(abs({ZT})) + 5e-5) AS x FROM forecast GROUP BY split, node, sample_id
 UNION ALL
 SELECT split, 'horizon_' || step, sum(abs({ZP} - {ZT})) / (sum(abs({ZT})) + 5e-5) FROM forecast GROUP BY split, step, sample_id)
GROUP BY split, scope""")
def horizon_metrics(spark, sf_dir):
    out = mt.horizon_metrics(user_forecast(spark, sf_dir), [1, 2, 3, 4], ["MAE", "WAPE"], ["split"], null_val=0.0)
    return out.select("split", "scope", "metric", r6("value").alias("value"))


@query("WITH " + FORECAST_SQL + f""", clean AS (
 SELECT split, CAST(step AS VARCHAR) AS feature, CASE WHEN target IS NOT NULL THEN prediction END AS p,
        CASE WHEN prediction IS NOT NULL THEN target END AS t FROM forecast),
per AS (SELECT split, feature, count(*) FILTER (WHERE abs(p - t) / (abs(t) + 1e-8) < 0.05) AS count_less_5,
  count(*) FILTER (WHERE abs(p - t) / (abs(t) + 1e-8) < 0.10) AS count_less_10, count(*) AS samples_count,
  1 - sum((t - p) * (t - p)) / nullif(var_pop(t) * count(t), 0) AS nse_val, sqrt(avg((t - p) * (t - p))) AS rmse_val,
  sqrt(avg((t - p) * (t - p))) / nullif(max(t) - min(t), 0) AS nrmse_val FROM clean GROUP BY split, feature),
rates AS (SELECT *, count_less_5 / samples_count AS per_less_5, count_less_10 / samples_count AS per_less_10 FROM per),
mean AS (SELECT split, sum(count_less_5) AS count_less_5, sum(count_less_10) AS count_less_10, max(samples_count) AS samples_count,
  avg(per_less_5) AS per_less_5, avg(per_less_10) AS per_less_10, avg(nse_val) AS nse_val, avg(rmse_val) AS rmse_val, avg(nrmse_val) AS nrmse_val
  FROM rates GROUP BY split),
pooled AS (SELECT split, 1 - sum((t - p) * (t - p)) / nullif(var_pop(t) * count(t), 0) AS nse_val, sqrt(avg((t - p) * (t - p))) AS rmse_val,
  sqrt(avg((t - p) * (t - p))) / nullif(max(t) - min(t), 0) AS nrmse_val FROM clean GROUP BY split),
together AS (
 SELECT split, feature, count_less_5, count_less_10, samples_count, per_less_5, per_less_10, nse_val, rmse_val, nrmse_val FROM rates
 UNION ALL SELECT split, 'avg', count_less_5, count_less_10, samples_count, per_less_5, per_less_10, nse_val, rmse_val, nrmse_val FROM mean
 UNION ALL SELECT m.split, 'all', count_less_5, count_less_10, samples_count, per_less_5, per_less_10, p.nse_val, p.rmse_val, p.nrmse_val
 FROM mean m JOIN pooled p ON p.split = m.split)
SELECT split, feature, CAST(count_less_5 AS BIGINT) AS count_less_5, CAST(count_less_10 AS BIGINT) AS count_less_10, samples_count,
 {', '.join(sql_r6(c) + ' AS ' + c for c in ('per_less_5', 'per_less_10', 'nse_val', 'rmse_val', 'nrmse_val'))},
 {sql_r6('nse_val')} AS r2_val FROM together""")
def feature_evaluation(spark, sf_dir):
    """MET14-MET17: the horizon step plays the feature, every split in one job."""
    out = ev.feature_table(user_forecast(spark, sf_dir), "step", ["split"])
    rounded = ["per_less_5", "per_less_10", "nse_val", "rmse_val", "nrmse_val", "r2_val"]
    return out.select("split", "feature", "count_less_5", "count_less_10", "samples_count",
                      *[r6(c).alias(c) for c in rounded])


@query(f"""WITH {FORECAST_SQL}, batch AS (
 SELECT split, sample_id, avg(abs(prediction - target)) AS mae, sqrt(avg((prediction - target) * (prediction - target))) AS rmse,
        count(target) AS n FROM forecast WHERE target IS NOT NULL AND prediction IS NOT NULL GROUP BY split, sample_id)
SELECT split, CAST(sum(n) AS BIGINT) AS n, {sql_r6('sum(mae * n) / sum(n)')} AS mae, {sql_r6('sqrt(sum(rmse * rmse * n) / sum(n))')} AS rmse
FROM batch GROUP BY split""")
def weighted_meter(spark, sf_dir):
    """MET13: every sample is a batch, weighted by its valid elements."""
    rows = user_forecast(spark, sf_dir).where("target IS NOT NULL AND prediction IS NOT NULL")
    err = F.col("prediction") - F.col("target")
    batch = rows.groupBy("split", "sample_id").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count("target").alias("n"))
    mae = mt.meter(batch, ["split"], "mae").withColumnRenamed("value", "mae")
    rmse = mt.meter(batch, ["split"], "rmse", squared=True).select("split", F.col("value").alias("rmse"))
    return mae.join(rmse, "split").select("split", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"))


@query(f"""WITH {FORECAST_SQL}, h AS (
 SELECT split, step AS epoch, avg(abs(prediction - target)) AS v, 'MAE' AS metric FROM forecast GROUP BY split, step
 UNION ALL SELECT split, step, avg(CASE WHEN abs(prediction - target) < 10 THEN 1.0 ELSE 0.0 END), 'accuracy' FROM forecast
 WHERE prediction IS NOT NULL AND target IS NOT NULL GROUP BY split, step)
SELECT split, metric, CAST(arg_min(epoch, (CASE WHEN metric = 'accuracy' THEN -v ELSE v END, epoch)) AS INTEGER) AS epoch,
 {sql_r6("arg_min(v, (CASE WHEN metric = 'accuracy' THEN -v ELSE v END, epoch))")} AS value FROM h GROUP BY split, metric""")
def best_model(spark, sf_dir):
    """SEL1 over a history in which each horizon step stands for an epoch."""
    rows = user_forecast(spark, sf_dir).where("target IS NOT NULL AND prediction IS NOT NULL")
    err = F.abs(F.col("prediction") - F.col("target"))
    wide = rows.groupBy("split", F.col("step").alias("epoch")).agg(
        F.avg(err).alias("MAE"), F.avg((err < 10).cast("double")).alias("accuracy"))
    history = mt.long_metrics(wide, ["split", "epoch"], ["MAE", "accuracy"])
    best = mt.best_model(history, ["split"], "metric", "value", "epoch")
    return best.select("split", "metric", F.col("epoch").cast("int").alias("epoch"), r6("value").alias("value"))
