"""The registry of named queries and the frames they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chronoloom.session import stage
from chronoloom.operators import models, panel as pn, split as sp, windows as wn

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function name, with its SQL twin if it has one."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# Settings of the demonstration panel: six-hour steps, windows of two days in
# and one day out, one season per day.
STEP_US = 6 * 3_600_000_000
HOUR_US = 3_600_000_000
IN_LEN, OUT_LEN, PERIOD = 8, 4, 4
RATIO = (0.7, 0.1, 0.2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero removes a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def user_axis(spark, sf_dir) -> pn.Axis:
    return pn.observed_axis(table(spark, sf_dir, "events"), "ts", STEP_US)


def user_panel(spark: SparkSession, sf_dir: str, axis: pn.Axis | None = None, staged: bool = False) -> DataFrame:
    """Mean event value per user and six hours; users grow with the data.

    Queries that read the panel more than once stage it, so the events behind
    it are read once.
    """
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), "ts", "value")
    out = pn.to_panel(events, ["node"], "ts", F.col("value"), axis or user_axis(spark, sf_dir))
    return stage(out) if staged else out


def type_axis(spark, sf_dir) -> pn.Axis:
    return pn.observed_axis(table(spark, sf_dir, "events"), "ts", HOUR_US)


def type_panel(spark: SparkSession, sf_dir: str, axis: pn.Axis | None = None, staged: bool = False) -> DataFrame:
    """Mean event value per event type and hour: few series over many steps."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("node"), "ts", "value")
    out = pn.to_panel(events, ["node"], "ts", F.col("value"), axis or type_axis(spark, sf_dir))
    return stage(out) if staged else out


def user_samples(
    spark: SparkSession, sf_dir: str, in_len: int = IN_LEN, out_len: int = OUT_LEN, staged: bool = False
) -> DataFrame:
    axis = user_axis(spark, sf_dir)
    bounds = sp.split_bounds(axis.length, RATIO, in_len, out_len)
    rows = sp.assign_splits(user_panel(spark, sf_dir, axis, staged), bounds)
    return wn.sliding_windows(rows, ["split", "node"], "pos", ["value"], in_len, out_len)


def user_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal-naive forecasts of every sample of every split, as arrays."""
    return models.with_seasonal_naive(user_samples(spark, sf_dir), IN_LEN, OUT_LEN, PERIOD)


def user_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form."""
    return models.forecast_rows(user_predictions(spark, sf_dir), ["split", "sample_id", "node"])


# The same frames in SQL.

def sql_r6(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def _panel_sql(name: str, key: str, step: int) -> str:
    return f"""
{name}_obs AS (SELECT {key} AS node, CAST(floor(epoch_us(ts) / {step}.0) AS BIGINT) AS b, value FROM events),
{name}_lim AS (SELECT min(b) AS b0, max(b) - min(b) + 1 AS steps FROM {name}_obs),
{name}_cells AS (SELECT node, b - b0 AS t_idx, avg(value) AS value FROM {name}_obs, {name}_lim GROUP BY node, b - b0),
{name} AS (
  SELECT n.node, r.t_idx, make_timestamp(CAST((r.t_idx + r.b0) * {step} AS BIGINT)) AS ts, c.value
  FROM (SELECT DISTINCT node FROM {name}_obs) n
  CROSS JOIN (SELECT unnest(range(steps)) AS t_idx, b0 FROM {name}_lim) r
  LEFT JOIN {name}_cells c ON c.node = n.node AND c.t_idx = r.t_idx)"""


PANEL_SQL = _panel_sql("panel", "user_id", STEP_US)
TYPES_SQL = _panel_sql("types", "event_type", HOUR_US)


def bounds_sql(in_len: int = IN_LEN, out_len: int = OUT_LEN, overlap: str = "false", source: str = "panel_lim") -> str:
    short = in_len + out_len
    return f"""
sz AS (SELECT steps, CAST(floor(steps * CAST({RATIO[1]} AS DOUBLE)) AS BIGINT) AS va,
              CAST(floor(steps * CAST({RATIO[2]} AS DOUBLE)) AS BIGINT) AS te FROM {source}),
bounds AS (
  SELECT 'train' AS split, CAST(0 AS BIGINT) AS lo,
         least(steps - va - te + CASE WHEN {overlap} OR {short} > steps - va - te THEN {out_len} ELSE 0 END, steps) AS hi FROM sz
  UNION ALL
  SELECT 'valid', greatest(steps - va - te - CASE WHEN {overlap} OR {short} > va THEN {in_len - 1} ELSE 0 END, 0),
         least(steps - te + CASE WHEN {overlap} OR {short} > va THEN {out_len} ELSE 0 END, steps) FROM sz
  UNION ALL
  SELECT 'test', greatest(steps - te - CASE WHEN {overlap} OR {short} > te THEN {in_len - 1} ELSE 0 END, 0), steps FROM sz)"""


SAMPLES_SQL = PANEL_SQL + "," + bounds_sql() + f""",
rows_in AS (SELECT split, node, t_idx - lo AS pos, hi - lo AS len, value FROM panel JOIN bounds ON t_idx >= lo AND t_idx < hi)"""

FORECAST_SQL = SAMPLES_SQL + f""",
history AS (
  SELECT split, node, pos, len, value,
         lag(value, {PERIOD}) OVER w AS season1, lag(value, {2 * PERIOD}) OVER w AS season2,
         avg(value) OVER (PARTITION BY split, node ORDER BY pos ROWS BETWEEN {IN_LEN} PRECEDING AND 1 PRECEDING) AS past_mean
  FROM rows_in WINDOW w AS (PARTITION BY split, node ORDER BY pos)),
forecast AS (
  SELECT a.split, a.pos - {IN_LEN} - h.h AS sample_id, a.node, h.h + 1 AS step, 0 AS channel,
         coalesce(a.season1, a.season2, m.past_mean) AS prediction, a.value AS target
  FROM history a CROSS JOIN (SELECT unnest(range({OUT_LEN})) AS h) h
  JOIN history m ON m.split = a.split AND m.node = a.node AND m.pos = a.pos - h.h
  WHERE a.pos - {IN_LEN} - h.h >= 0 AND a.pos - h.h + {OUT_LEN} <= a.len)"""


def spline_sql(points: str) -> str:
    """Common table expressions that solve the not-a-knot spline of each series of ``points(s, x, y)``.

    They end in ``pieces(s, i, n, x0, y0, m0, x1, y1, m1)`` and need WITH RECURSIVE:
    one step per knot forward, one back, for all series at once.
    """
    return f"""
sp_k AS (SELECT s, x, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM {points} WINDOW w AS (PARTITION BY s ORDER BY x)),
sp_e AS MATERIALIZED (SELECT s, i, n, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(x) OVER w - x AS h,
 (lead(y) OVER w - y) / (lead(x) OVER w - x) AS slope FROM sp_k WHERE n >= 4 WINDOW w AS (PARTITION BY s ORDER BY i)),
sp_c AS (SELECT s, i, n, lag(h) OVER w AS hl, h AS hr, 6 * (slope - lag(slope) OVER w) AS rhs FROM sp_e WINDOW w AS (PARTITION BY s ORDER BY i)),
sp_r AS MATERIALIZED (SELECT s, i, n, rhs, CASE WHEN i = 1 THEN 0 WHEN i = n - 2 THEN hl - hr * hr / hl ELSE hl END AS low,
 2 * (hl + hr) + CASE WHEN i = 1 THEN hl * (1 + hl / hr) WHEN i = n - 2 THEN hr * (1 + hr / hl) ELSE 0 END AS mid,
 CASE WHEN i = n - 2 THEN 0 WHEN i = 1 THEN hr - hl * hl / hr ELSE hr END AS up FROM sp_c WHERE i BETWEEN 1 AND n - 2),
sp_forward(s, i, n, g, d) AS (SELECT s, i, n, up / mid, rhs / mid FROM sp_r WHERE i = 1 UNION ALL
 SELECT r.s, r.i, r.n, r.up / (r.mid - r.low * f.g), (r.rhs - r.low * f.d) / (r.mid - r.low * f.g)
 FROM sp_forward f JOIN sp_r r ON r.s = f.s AND r.i = f.i + 1),
sp_f AS MATERIALIZED (SELECT * FROM sp_forward),
sp_back(s, i, m) AS (SELECT s, i, d FROM sp_f WHERE i = n - 2 UNION ALL
 SELECT f.s, f.i, f.d - f.g * b.m FROM sp_back b JOIN sp_f f ON f.s = b.s AND f.i = b.i - 1),
sp_b AS MATERIALIZED (SELECT * FROM sp_back),
sp_m AS (SELECT * FROM sp_b UNION ALL
 SELECT a.s, 0, (1 + a.h / b.h) * p.m - a.h / b.h * q.m FROM sp_e a JOIN sp_e b ON b.s = a.s AND b.i = 1
 JOIN sp_b p ON p.s = a.s AND p.i = 1 JOIN sp_b q ON q.s = a.s AND q.i = 2 WHERE a.i = 0 UNION ALL
 SELECT a.s, a.n - 1, (1 + a.h / b.h) * p.m - a.h / b.h * q.m FROM sp_e a JOIN sp_e b ON b.s = a.s AND b.i = a.n - 3
 JOIN sp_b p ON p.s = a.s AND p.i = a.n - 2 JOIN sp_b q ON q.s = a.s AND q.i = a.n - 3 WHERE a.i = a.n - 2),
pieces AS MATERIALIZED (SELECT e.s, e.i, e.n, e.x AS x0, e.y AS y0, a.m AS m0, x1, y1, b.m AS m1 FROM sp_e e
 JOIN sp_m a ON a.s = e.s AND a.i = e.i JOIN sp_m b ON b.s = e.s AND b.i = e.i + 1 WHERE e.i < e.n - 1)"""


def piece_on(series: str, at: str) -> str:
    """Join condition of the piece of a series at ``at``; the outer ones reach on."""
    return f"p.s = {series} AND ({at} >= p.x0 OR p.i = 0) AND ({at} < p.x1 OR p.i = p.n - 2)"


def cubic_sql(at: str) -> str:
    a, b, h = f"((p.x1 - {at}) / (p.x1 - p.x0))", f"(({at} - p.x0) / (p.x1 - p.x0))", "(p.x1 - p.x0)"
    return f"({a} * p.y0 + {b} * p.y1 + (({a} * {a} * {a} - {a}) * p.m0 + ({b} * {b} * {b} - {b}) * p.m1) * {h} * {h} / 6)"
