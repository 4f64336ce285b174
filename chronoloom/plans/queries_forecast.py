"""Forecasting, scoring, selection and whole cleaning jobs as named queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from chronoloom.functions import arrays
from chronoloom.operators import forecast as fc, impute, metrics as mt, models, panel as pn, split as sp, windows as wn
from chronoloom.plans import cleaning as cl
from chronoloom.session import stage
from chronoloom.plans.catalog import (
    FORECAST_SQL, IN_LEN, OUT_LEN, PANEL_SQL, PERIOD, RATIO, SAMPLES_SQL, STEP_US, bounds_sql, cubic_sql, piece_on, query, r6,
    spline_sql, sql_r6, table, user_axis, user_forecast, user_panel, user_samples,
)

FILLED_SQL = PANEL_SQL + """,
filled AS (SELECT node, t_idx, ts, value AS raw, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM panel)"""


def _filled(spark, sf_dir, axis):
    return impute.fill_both_ways(user_panel(spark, sf_dir, axis, staged=True), ["node"], "t_idx", "value")


def _filled_samples(spark, sf_dir):
    axis = user_axis(spark, sf_dir)
    rows = sp.assign_splits(_filled(spark, sf_dir, axis), sp.split_bounds(axis.length, RATIO, IN_LEN, OUT_LEN))
    return wn.sliding_windows(rows, ["split", "node"], "pos", ["value"], IN_LEN, OUT_LEN)


def season_of(x: np.ndarray, period: int) -> np.ndarray:
    """A user model with a parameter: the last season that has the step, else the mean of the window."""
    n = x.shape[1]
    there = ~np.isnan(x)
    mean = np.where(there.any(1), np.nansum(x, 1) / np.maximum(there.sum(1), 1), np.nan)
    out = np.repeat(mean[:, None], OUT_LEN, 1)
    for h in range(OUT_LEN):
        for at in range((n + h) % period, n, period):  # later ones win
            out[:, h] = np.where(there[:, at], x[:, at], out[:, h])
    return out


def window_mean(x: np.ndarray) -> np.ndarray:
    """A user model: the mean of the window, repeated."""
    return np.repeat(x.mean(1, keepdims=True), OUT_LEN, axis=1)


@query(f"WITH {FORECAST_SQL} SELECT split, sample_id, node, CAST(step AS INTEGER) AS step, {sql_r6('prediction')} AS prediction, {sql_r6('target')} AS target FROM forecast")
def seasonal_naive(spark, sf_dir):
    out = user_forecast(spark, sf_dir)
    return out.select("split", "sample_id", "node", "step", r6("prediction").alias("prediction"), r6("target").alias("target"))


@query(f"""WITH {FILLED_SQL}, {bounds_sql()},
rows_in AS (SELECT split, node, t_idx - lo AS pos, hi - lo AS len, value FROM filled JOIN bounds ON t_idx >= lo AND t_idx < hi),
m AS (SELECT *, avg(value) OVER (PARTITION BY split, node ORDER BY pos ROWS BETWEEN {IN_LEN} PRECEDING AND 1 PRECEDING) AS mean FROM rows_in)
SELECT split, node, pos - {IN_LEN} AS sample_id, CAST(h.h + 1 AS INTEGER) AS step, {sql_r6('mean', 9)} AS prediction
FROM m CROSS JOIN (SELECT unnest(range({OUT_LEN})) AS h) h WHERE pos >= {IN_LEN} AND pos + {OUT_LEN} <= len""")
def user_model_scoring(spark, sf_dir):
    """SCO1/SCO3 with a plain Python model."""
    out = fc.score(_filled_samples(spark, sf_dir), window_mean, ["split", "node", "sample_id"], OUT_LEN)
    out = models.forecast_rows(out, ["split", "node", "sample_id"])
    return out.select("split", "node", "sample_id", "step", r6("prediction", 9).alias("prediction"))


def frequency_sql(dataset: str = "''", ridge: float = 10.0) -> str:
    """Common table expressions that fit the linear map between spectra and score every sample: ``made``.

    Normal equations of the training samples per dataset are solved by
    elimination, one step per spectral coefficient.
    """
    p, half_in, half_out = 2 * (IN_LEN // 2 + 1), IN_LEN // 2 + 1, OUT_LEN // 2 + 1
    step = lambda k: f"""m{k + 1} AS MATERIALIZED (SELECT a.ds, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v
 FROM m{k} a JOIN m{k} r ON r.ds = a.ds AND r.i = {k} AND r.j = a.j JOIN m{k} c ON c.ds = a.ds AND c.i = a.i AND c.j = {k}
 JOIN m{k} p ON p.ds = a.ds AND p.i = {k} AND p.j = {k})"""  # noqa: E731
    wave = lambda n, half, h: f"""SELECT ds, split, node, sample_id, f AS i, sum(z * cos(2 * pi() * f * {h} / {n})) AS v FROM z CROSS JOIN (SELECT unnest(range({half})) AS f) WHERE {h} BETWEEN 0 AND {n - 1} GROUP BY ALL
 UNION ALL SELECT ds, split, node, sample_id, f + {half}, -sum(z * sin(2 * pi() * f * {h} / {n})) FROM z CROSS JOIN (SELECT unnest(range({half})) AS f) WHERE {h} BETWEEN 0 AND {n - 1} GROUP BY ALL"""  # noqa: E731
    return f"""{FILLED_SQL}, {bounds_sql()},
rows_in AS MATERIALIZED (SELECT {dataset} AS ds, split, node, t_idx - lo AS pos, hi - lo AS len, value FROM filled JOIN bounds ON t_idx >= lo AND t_idx < hi
 {"JOIN customer ON c_custkey = node" if dataset != "''" else ""}),
win AS MATERIALIZED (SELECT s.ds, s.split, s.node, s.pos AS sample_id, r.pos - s.pos AS h, r.value FROM rows_in s JOIN rows_in r
 ON r.split = s.split AND r.node = s.node AND r.pos BETWEEN s.pos AND s.pos + {IN_LEN + OUT_LEN - 1} WHERE s.pos + {IN_LEN + OUT_LEN} <= s.len),
st AS MATERIALIZED (SELECT split, node, sample_id, avg(value) FILTER (WHERE h < {IN_LEN}) AS mean, sqrt(var_pop(value) FILTER (WHERE h < {IN_LEN}) + 1e-5) AS sd FROM win GROUP BY ALL),
z AS MATERIALIZED (SELECT win.*, (value - mean) / sd AS z FROM win JOIN st USING (split, node, sample_id)),
past AS MATERIALIZED ({wave(IN_LEN, half_in, "h")}), future AS MATERIALIZED ({wave(OUT_LEN, half_out, f"(h - {IN_LEN})")}),
m0 AS MATERIALIZED (SELECT a.ds, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN {ridge} ELSE 0 END AS v FROM past a JOIN past b USING (split, node, sample_id) WHERE split = 'train' GROUP BY a.ds, a.i, b.i
 UNION ALL SELECT a.ds, a.i, b.i + {p}, sum(a.v * b.v) FROM past a JOIN future b USING (split, node, sample_id) WHERE split = 'train' GROUP BY a.ds, a.i, b.i),
{", ".join(step(k) for k in range(p))},
spectra AS (SELECT a.ds, a.split, a.node, a.sample_id, w.j - {p} AS j, sum(a.v * w.v) AS v FROM past a JOIN m{p} w ON w.ds = a.ds AND w.i = a.i AND w.j >= {p} GROUP BY ALL),
made AS (SELECT y.ds, y.split, y.node, y.sample_id, k + 1 AS step, any_value(mean) + any_value(sd) / {OUT_LEN} * sum(CASE
 WHEN j = 0 THEN v WHEN j = {half_out - 1} THEN v * cos(pi() * k) WHEN j < {half_out} THEN 2 * v * cos(2 * pi() * j * k / {OUT_LEN})
 WHEN j > {half_out} AND j < {2 * half_out - 1} THEN -2 * v * sin(2 * pi() * (j - {half_out}) * k / {OUT_LEN}) ELSE 0 END) AS prediction
 FROM spectra y JOIN st USING (split, node, sample_id) CROSS JOIN (SELECT unnest(range({OUT_LEN})) AS k) GROUP BY ALL),
scored AS MATERIALIZED (SELECT made.*, win.value AS target FROM made JOIN win ON win.split = made.split AND win.node = made.node AND win.sample_id = made.sample_id AND win.h = made.step + {IN_LEN - 1})"""


@query(f"""WITH {frequency_sql()}, g AS (SELECT split, node, sample_id, sum(abs(prediction - target)) / (sum(abs(target)) + 5e-5) AS x FROM scored GROUP BY ALL),
w AS (SELECT split, avg(x) AS wape FROM g GROUP BY split)
SELECT split, {sql_r6('avg(abs(prediction - target))', 5)} AS mae, {sql_r6('sqrt(avg((prediction - target) * (prediction - target)))', 5)} AS rmse,
 {sql_r6('any_value(wape)', 5)} AS wape FROM scored JOIN w USING (split) GROUP BY split""")
def freq_linear_forecast(spark, sf_dir):
    """MDL1: fitted on the training split, scored on all three."""
    samples = stage(_filled_samples(spark, sf_dir))
    model = fc.fit_frequency_linear(samples.where("split = 'train'"), IN_LEN, OUT_LEN, ridge=10.0)
    out = models.forecast_rows(fc.score(samples, model, ["split", "node", "sample_id"], OUT_LEN), ["split", "node", "sample_id"])
    wide = mt.evaluate(out, ["MAE", "RMSE", "WAPE"], ["split"], null_val=None)
    return wide.select("split", *[r6(m, 5).alias(m.lower()) for m in ("MAE", "RMSE", "WAPE")])


@query(f"""WITH {frequency_sql("c_mktsegment")}
SELECT ds AS dataset, split, {sql_r6('avg(abs(prediction - target))', 5)} AS mae FROM scored GROUP BY ds, split""")
def model_per_segment(spark, sf_dir):
    """MDL4: a model per market segment, all fitted in one pass, evaluated per segment."""
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("dataset"))
    samples = stage(_filled_samples(spark, sf_dir).join(segment, "node"))
    fitted = fc.fit_per_dataset(samples.where("split = 'train'"), "dataset", IN_LEN, OUT_LEN, ridge=10.0)
    out = fc.score_per_dataset(samples, fitted, "dataset", ["split", "node", "sample_id"], IN_LEN, OUT_LEN)
    rows = models.forecast_rows(out, ["dataset", "split", "node", "sample_id"])
    return mt.evaluate(rows, ["MAE"], ["dataset", "split"]).select("dataset", "split", r6("MAE", 5).alias("mae"))


@query(f"""WITH {FILLED_SQL}, tail AS (SELECT node, avg(value) AS mean, max(ts) AS last_ts FROM filled CROSS JOIN panel_lim WHERE t_idx >= steps - {IN_LEN} GROUP BY node)
SELECT node, last_ts + to_microseconds((h + 1) * {STEP_US}) AS ts, strftime(last_ts + to_microseconds((h + 1) * {STEP_US}), '%Y-%m-%d %H:%M:%S') AS stamp, {sql_r6('mean', 9)} AS value
FROM tail CROSS JOIN (SELECT unnest(range({OUT_LEN})) AS h)""")
def future_forecast(spark, sf_dir):
    """SCO2: the next day of every series from its last window."""
    from chronoloom.plans.forecasting import forecast_future

    axis = user_axis(spark, sf_dir)
    out = forecast_future(_filled(spark, sf_dir, axis), window_mean, ["node"], "value", IN_LEN, OUT_LEN, STEP_US, axis.length - 1)
    return out.select("node", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), r6("value", 9).alias("value"))


PERIODS = (2, 4, 8)
GRID_SQL = f"""{SAMPLES_SQL}, tries AS (
 SELECT p.p AS period, a.node, a.pos AS sample_id, h.h AS h, k.k AS k, b.value
 FROM rows_in a CROSS JOIN (SELECT unnest([{', '.join(map(str, PERIODS))}]) AS p) p CROSS JOIN (SELECT unnest(range({OUT_LEN})) AS h) h
 CROSS JOIN (SELECT unnest(range({IN_LEN})) AS k) k
 JOIN rows_in b ON b.split = a.split AND b.node = a.node AND b.pos = a.pos + k.k
 WHERE a.split = 'valid' AND a.pos + {IN_LEN + OUT_LEN} <= a.len),
made AS (SELECT period, node, sample_id, h, coalesce(arg_max(value, k) FILTER (WHERE value IS NOT NULL AND ({IN_LEN} + h - k) % period = 0), avg(value)) AS prediction
 FROM tries GROUP BY ALL),
scored AS (SELECT period, sum(coalesce(abs(prediction - t.value), 0)) / count(*) AS mae FROM made m JOIN rows_in t ON t.split = 'valid' AND t.node = m.node
 AND t.pos = m.sample_id + {IN_LEN} + m.h WHERE t.value IS NOT NULL GROUP BY period)"""


@query(f"WITH {GRID_SQL} SELECT CAST(period AS INTEGER) AS period, {sql_r6('mae')} AS mae, CAST(row_number() OVER (ORDER BY mae) AS INTEGER) AS rank FROM scored")
def grid_rank(spark, sf_dir):
    """MDL3, SET3, TOP1: seasons of the naive forecast, best validation error first."""
    samples = user_samples(spark, sf_dir).where("split = 'valid'")
    tried = fc.grid_search(samples, sp.parameter_grid(spark, {"period": PERIODS}), season_of, OUT_LEN)
    best = fc.rank_grid(tried)
    # at most ten rows remain, so ranking them in one task is bounded
    rank = F.row_number().over(Window.orderBy("metric"))
    return best.select(F.col("period").cast("int").alias("period"), r6("metric").alias("mae"), rank.alias("rank"))


@query(f"""WITH {FORECAST_SQL}
SELECT split, {sql_r6('sum(coalesce(abs(prediction - target), 0)) / count(*)')} AS mae FROM forecast WHERE target IS NOT NULL AND step <= 2 GROUP BY split""")
def curriculum_mae(spark, sf_dir):
    """PRJ19 in the fourth epoch: one warm-up epoch, a step more every third epoch."""
    rows = pn.curriculum_steps(user_forecast(spark, sf_dir), epoch=5, warm_up=1, cl_epochs=3, step=1, length=OUT_LEN)
    return mt.evaluate(rows, ["MAE"], ["split"]).select("split", r6("MAE").alias("mae"))


@query(f"""SELECT label, count(*) AS n, {sql_r6('avg(CASE WHEN list_position(embedding[1:10], list_max(embedding[1:10])) - 1 = label THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM embeddings GROUP BY label""")
def accuracy_argmax(spark, sf_dir):
    """SCO4: the first ten coordinates stand for class scores."""
    rows = table(spark, sf_dir, "embeddings").select(
        "label", arrays.argmax(F.slice("embedding", 1, 10)).alias("prediction"), F.col("label").alias("target"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(mt.accuracy()).alias("accuracy"))


@query(f"""WITH {SAMPLES_SQL}, s AS (SELECT split, node, pos AS sample_id FROM rows_in WHERE pos + {IN_LEN + OUT_LEN} <= len),
c AS (SELECT * FROM s ORDER BY md5(split || '|' || node || '|' || sample_id || '|7'), split, node, sample_id LIMIT 100)
SELECT c.split, c.node, c.sample_id, {sql_r6('avg(r.value)')} AS mean FROM c JOIN rows_in r
 ON r.split = c.split AND r.node = c.node AND r.pos BETWEEN c.sample_id AND c.sample_id + {IN_LEN - 1} GROUP BY ALL""")
def random_windows(spark, sf_dir):
    """WIN5: a fixed random choice."""
    out = wn.random_samples(user_samples(spark, sf_dir, staged=True), ["split", "node", "sample_id"], 100, seed=7)
    return out.select("split", "node", "sample_id", r6(arrays.array_mean("inputs")).alias("mean"))


# Sensor-like data: users are stations, event types are indicators, most cells are empty.

TYPES = ["click", "error", "purchase", "signup", "view"]


def sensor_config(spark):
    rows = [("click", 9, 0.0, 300.0, "cubic"), ("error", 9, 0.0, 300.0, "cubic"), ("purchase", 9, 0.0, 300.0, "linear"),
            ("signup", 9, 0.0, 300.0, "cubic"), ("view", 9, 0.0, 300.0, "linear")]
    return spark.createDataFrame(rows, "indicator string, decimals int, min_val double, max_val double, interpolation string")


def sensor_panel(spark, sf_dir):
    axis = user_axis(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    stations = events.select(F.col("user_id").alias("station")).distinct()
    indicators = F.array(*[F.lit(t) for t in TYPES])
    filler = stations.select(
        "station", F.explode(indicators).alias("indicator"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("value"))
    rows = events.select(F.col("user_id").alias("station"), F.col("event_type").alias("indicator"), "ts", "value")
    panel = pn.to_panel(rows.unionByName(filler), ["station", "indicator"], "ts", F.col("value"), axis)
    return stage(panel.where(F.col("t_idx").isNotNull()))


SENSOR_SQL = PANEL_SQL + f""",
sensor AS (SELECT n.node AS station, i.i AS indicator, r.t_idx, c.value FROM (SELECT DISTINCT node FROM panel_obs) n
 CROSS JOIN (SELECT unnest({TYPES}) AS i) i CROSS JOIN (SELECT unnest(range(steps)) AS t_idx, b0 FROM panel_lim) r
 LEFT JOIN (SELECT user_id, event_type, CAST(floor(epoch_us(ts) / {STEP_US}.0) AS BIGINT) AS b, avg(value) AS value FROM events GROUP BY ALL) c
 ON c.user_id = n.node AND c.event_type = i.i AND c.b = r.t_idx + r.b0),
s_marked AS (SELECT *, t_idx - row_number() OVER (PARTITION BY station, indicator, value IS NULL ORDER BY t_idx) AS island FROM sensor),
s_runs AS (SELECT station, indicator, min(t_idx) AS start, count(*) AS n FROM s_marked WHERE value IS NULL GROUP BY station, indicator, island),
limits(strategy, max_gap, z_limit) AS (VALUES ('conservative', 50, 3.0), ('aggressive', 30, 2.5), ('segmented', 100, 3.5)),
steps_kept AS (SELECT DISTINCT strategy, z_limit, station, t_idx FROM sensor s CROSS JOIN limits l WHERE NOT EXISTS (
 SELECT 1 FROM s_runs r WHERE r.station = s.station AND r.n >= l.max_gap AND s.t_idx >= r.start AND s.t_idx < r.start + r.n))"""


@query(f"""WITH {SENSOR_SQL}, kept AS (SELECT strategy, station, count(*) AS n FROM steps_kept GROUP BY ALL)
SELECT l.strategy, s.station, (SELECT steps FROM panel_lim) AS rows_before, coalesce(n, 0) AS rows_after,
 {sql_r6('coalesce(n, 0) * 100.0 / (SELECT steps FROM panel_lim)')} AS retention_pct, CASE WHEN n > 0 THEN 'success' ELSE 'empty' END AS status
FROM (SELECT DISTINCT station FROM sensor) s CROSS JOIN limits l LEFT JOIN kept k ON k.strategy = l.strategy AND k.station = s.station""")
def batch_report(spark, sf_dir):
    """PIPE4: what each strategy keeps of each station."""
    config = sensor_config(spark)
    names = [r.indicator for r in config.collect()]
    panel = sensor_panel(spark, sf_dir)
    report = cl.batch_report(panel, cl.strategies_without_gaps(panel, names))
    return report.select("strategy", "station", "rows_before", "rows_after", r6("retention_pct").alias("retention_pct"), "status")


def knn_sql(source: str, station: str, row: str, names: list[str], prefix: str = "") -> str:
    """Common table expressions that impute a wide relation into ``f_<name>`` columns."""
    n = float(len(names))
    return f"""
st AS (SELECT {station}, {', '.join(f'avg({t}) AS m_{t}, CASE WHEN stddev_pop({t}) = 0 THEN 1 ELSE stddev_pop({t}) END AS s_{t}' for t in names)} FROM {source} GROUP BY {station}),
z AS (SELECT w.{station}, w.{row}, {', '.join(f'({t} - m_{t}) / s_{t} AS {t}' for t in names)} FROM {source} w JOIN st USING ({station})),
pairs AS (SELECT a.{station}, a.{row}, b.{row} AS donor, round(sqrt({n} / shared * total), 9) AS dist,
 {', '.join(f'CASE WHEN a.{t} IS NULL THEN b.{t} END AS d_{t}' for t in names)}
 FROM z a JOIN z b ON b.{station} = a.{station}
 CROSS JOIN LATERAL (SELECT {' + '.join(f'CAST(a.{t} IS NOT NULL AND b.{t} IS NOT NULL AS INTEGER)' for t in names)} AS shared,
  {' + '.join(f'coalesce((a.{t} - b.{t}) * (a.{t} - b.{t}), 0)' for t in names)} AS total) WHERE shared > 0),
{', '.join(f'''f_{t} AS (SELECT {station}, {row}, avg(v) AS v FROM (SELECT {station}, {row}, d_{t} AS v,
 row_number() OVER (PARTITION BY {station}, {row} ORDER BY dist, donor) AS rn FROM pairs WHERE d_{t} IS NOT NULL) WHERE rn <= 5 GROUP BY {station}, {row})''' for t in names)},
imputed AS (SELECT w.* EXCLUDE ({', '.join(names)}), {', '.join(f'coalesce(w.{t}, coalesce(f_{t}.v, 0) * s_{t} + m_{t}) AS {t}' for t in names)}
 FROM {source} w JOIN st ON st.{station} = w.{station} {' '.join(f'LEFT JOIN f_{t} ON f_{t}.{station} = w.{station} AND f_{t}.{row} = w.{row}' for t in names)})"""


@query(f"""WITH {SENSOR_SQL}, kept AS (SELECT s.*, z_limit FROM sensor s JOIN steps_kept k ON k.station = s.station AND k.t_idx = s.t_idx AND strategy = 'aggressive'),
o AS (SELECT station, t_idx, indicator, CASE WHEN count(value) OVER p >= 10 AND abs((value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0)) > z_limit THEN NULL ELSE value END AS value
 FROM kept WINDOW p AS (PARTITION BY station, indicator)),
wide AS (SELECT station, t_idx, row_number() OVER (PARTITION BY station ORDER BY t_idx) - 1 AS pos,
 {', '.join(f"max(value) FILTER (WHERE indicator = '{t}') AS {t}" for t in TYPES)} FROM o GROUP BY station, t_idx),
{knn_sql('wide', 'station', 'pos', TYPES)}
SELECT station, t_idx, CAST(pos AS BIGINT) AS pos, indicator, {sql_r6("round_even(value, 9)", 9)} AS value
FROM imputed UNPIVOT INCLUDE NULLS (value FOR indicator IN ({', '.join(TYPES)}))""")
def clean_aggressive(spark, sf_dir):
    """PIPE2: gaps and outliers out, nearest neighbours in, rounded."""
    out = cl.clean_stations(sensor_panel(spark, sf_dir), sensor_config(spark), "aggressive")
    return out.select("station", "t_idx", "pos", "indicator", r6("value", 9).alias("value"))


SENSOR_KIND_SQL = "CASE WHEN indicator IN ('click', 'error', 'signup') THEN 'cubic' ELSE 'linear' END"


def fill_sql(source: str, at: str, sparse: bool) -> str:
    """Common table expressions that fill ``source(station, indicator, t_idx, <at>, value)`` as the chain does: ``done``."""
    lone = "coalesce(value, pv, nv)" if sparse else "value"
    return f"""
kinds AS (SELECT *, {SENSOR_KIND_SQL} AS kind, station || '/' || indicator AS series, count(value) OVER w AS valid, count(*) OVER w AS n_all FROM {source}
 WINDOW w AS (PARTITION BY station, indicator)),
pts AS (SELECT series AS s, {at}::DOUBLE AS x, value AS y FROM kinds WHERE kind = 'cubic' AND value IS NOT NULL), {spline_sql("pts")},
sides AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN {at} END) OVER (PARTITION BY series ORDER BY {at}) AS pa,
 min(CASE WHEN value IS NOT NULL THEN {at} END) OVER (PARTITION BY series ORDER BY {at} DESC) AS na FROM kinds),
near AS (SELECT s.*, a.value AS pv, b.value AS nv FROM sides s LEFT JOIN kinds a ON a.series = s.series AND a.{at} = s.pa
 LEFT JOIN kinds b ON b.series = s.series AND b.{at} = s.na),
done AS (SELECT station, indicator, t_idx, near.{at}, CASE WHEN value IS NOT NULL THEN CASE WHEN n_all > valid AND valid >= 2 THEN least(greatest(value, 0), 300) ELSE value END
 WHEN valid >= 2 THEN least(greatest(coalesce({cubic_sql("near." + at)}, pv + (nv - pv) * (near.{at} - pa) / nullif(na - pa, 0), pv, nv), 0), 300)
 ELSE {lone} END AS value
 FROM near LEFT JOIN pieces p ON value IS NULL AND {piece_on("near.series", "near." + at)})"""


def stations_sql(strategy: str) -> str:
    """Rows a strategy keeps, without outliers: ``o(station, t_idx, indicator, pos, value)``."""
    return f"""{SENSOR_SQL}, kept AS (SELECT s.*, z_limit FROM sensor s JOIN steps_kept k ON k.station = s.station AND k.t_idx = s.t_idx AND strategy = '{strategy}'),
o AS (SELECT station, t_idx, indicator, row_number() OVER (PARTITION BY station, indicator ORDER BY t_idx) - 1 AS pos,
 CASE WHEN count(value) OVER p >= 10 AND abs((value - avg(value) OVER p) / nullif(stddev_samp(value) OVER p, 0)) > z_limit THEN NULL ELSE value END AS value
 FROM kept WINDOW p AS (PARTITION BY station, indicator))"""


@query(f"""WITH RECURSIVE {stations_sql("segmented")}, {fill_sql("o", "pos", False)}
SELECT station, t_idx, CAST(pos AS BIGINT) AS pos, indicator, {sql_r6("round(CAST(value AS DECIMAL(18, 9)), 4)", 4)} AS value FROM done""")
def clean_segmented(spark, sf_dir):
    """PIPE2 with interpolation."""
    out = cl.clean_stations(sensor_panel(spark, sf_dir), sensor_config(spark), "segmented")
    return out.select("station", "t_idx", "pos", "indicator", r6("value", 4).alias("value"))


@query(f"""WITH RECURSIVE {SENSOR_SQL}, read AS (SELECT station, indicator, t_idx, CASE WHEN value > 0 THEN value END AS v FROM sensor),
q AS (SELECT *, quantile_cont(v, 0.25) OVER w AS a, quantile_cont(v, 0.75) OVER w AS b, count(v) OVER w AS n FROM read WINDOW w AS (PARTITION BY station, indicator)),
checked AS (SELECT station, indicator, t_idx, CASE WHEN n <= 10 THEN v WHEN v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a) OR v < 0 OR v > 300 THEN NULL ELSE v END AS value FROM q),
{fill_sql("checked", "t_idx", True).replace("near.t_idx, CASE", "CASE", 1).replace("SELECT station, indicator, t_idx, CASE", "SELECT station, indicator, near.t_idx, CASE", 1)}
SELECT station, t_idx, indicator, {sql_r6("round(CAST(value AS DECIMAL(18, 9)), 4)", 4)} AS value FROM done""")
def clean_enhanced(spark, sf_dir):
    """PIPE3 from raw text."""
    panel = sensor_panel(spark, sf_dir).withColumn("raw", F.concat(F.lit("\x02"), F.col("value").cast("string")))
    out = cl.enhanced_cleaning(panel.drop("value"), sensor_config(spark))
    return out.select("station", "t_idx", "indicator", r6("value", 4).alias("value"))


@query(f"""WITH {FORECAST_SQL}, per AS (SELECT split, CAST(step AS VARCHAR) AS feature,
 1 - sum((target - prediction) * (target - prediction)) / nullif(var_pop(target) * count(target), 0) AS r2_val,
 sqrt(avg((target - prediction) * (target - prediction))) / nullif(max(target) - min(target), 0) AS nrmse_val,
 count(*) FILTER (WHERE abs(prediction - target) / (abs(target) + 1e-8) < 0.05) AS c5
 FROM forecast WHERE target IS NOT NULL AND prediction IS NOT NULL GROUP BY split, step),
n AS (SELECT split, step, count(*) AS n FROM forecast GROUP BY split, step),
t AS (SELECT p.split, r2_val, nrmse_val, c5 * 1.0 / n.n AS per_less_5 FROM per p JOIN n ON n.split = p.split AND CAST(n.step AS VARCHAR) = p.feature),
a AS (SELECT split, count(*) FILTER (WHERE r2_val < 0) AS neg, count(*) FILTER (WHERE r2_val < 0.5) * 1.0 / count(*) AS low, max(nrmse_val) AS worst, avg(per_less_5) AS near FROM t GROUP BY split)
SELECT split, array_to_string(list_filter([CASE WHEN neg > 0 THEN neg || ' feature(s) r2<0 (worse-than-mean)' END,
 CASE WHEN low > 0.3 THEN '>30% features r2<0.5 (weak generalization)' END, CASE WHEN worst > 0.5 THEN 'high nrmse on some features (>0.5)' END,
 CASE WHEN near < 0.3 THEN 'low <5% relative error proportion (<0.3)' END], lambda x: x IS NOT NULL), '; ') AS issues FROM a""")
def diagnose(spark, sf_dir):
    """PR5 on the per-step table of the naive forecast."""
    from chronoloom.operators import evaluate as ev, profile as pf

    rows = ev.feature_table(user_forecast(spark, sf_dir), "step", ["split"]).where(~F.col("feature").isin("avg", "all"))
    return pf.diagnose(rows, ["split"]).select("split", F.array_join("issues", "; ").alias("issues"))
