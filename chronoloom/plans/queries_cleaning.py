"""Scaling, transforms, gaps, outliers, imputation and profiles as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import gaps, impute, knn, outliers, profile as pf, scalers as sc
from chronoloom.operators import panel as pn
from chronoloom.operators.spline import spline_values
from chronoloom.functions.calendar import micros
from chronoloom.session import stage
from chronoloom.plans.catalog import (
    PANEL_SQL, TYPES_SQL, cubic_sql, piece_on, query, r6, spline_sql, sql_r6, table, type_panel, user_axis, user_panel,
)

TRAIN = 0.7
FIT_SQL = f"fit AS (SELECT p.* FROM panel p CROSS JOIN panel_lim WHERE t_idx < floor(steps * CAST({TRAIN} AS DOUBLE)))"


def _panel_and_steps(spark, sf_dir):
    axis = user_axis(spark, sf_dir)
    return user_panel(spark, sf_dir, axis, staged=True), sc.train_steps(axis.length, TRAIN)


@query(f"""WITH {PANEL_SQL}, {FIT_SQL}
SELECT node, {sql_r6('avg(value)')} AS mean, {sql_r6('CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END')} AS std
FROM fit GROUP BY node""")
def zscore_fit(spark, sf_dir):
    panel, steps = _panel_and_steps(spark, sf_dir)
    return sc.zscore_fit(panel, ["node"], "value", steps).select("node", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"""WITH {PANEL_SQL}, {FIT_SQL}, s AS (SELECT node, avg(value) AS m,
 CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS d FROM fit GROUP BY node)
SELECT p.node, t_idx, {sql_r6('(value - m) / d', 5)} AS scaled, {sql_r6('value', 5)} AS restored FROM panel p LEFT JOIN s ON s.node = p.node""")
def zscore_transform(spark, sf_dir):
    panel, steps = _panel_and_steps(spark, sf_dir)
    stats = sc.zscore_fit(panel, ["node"], "value", steps)
    out = sc.zscore_transform(panel, stats, ["node"], "value", "scaled")
    out = sc.zscore_inverse(out, stats, ["node"], "scaled", "restored")
    return out.select("node", "t_idx", r6("scaled", 5).alias("scaled"), r6("restored", 5).alias("restored"))


@query(f"""WITH {PANEL_SQL}, {FIT_SQL}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM fit)
SELECT node, t_idx, {sql_r6('(value - m) / d', 5)} AS scaled FROM panel CROSS JOIN s""")
def zscore_global(spark, sf_dir):
    panel, steps = _panel_and_steps(spark, sf_dir)
    stats = sc.zscore_fit(panel, [], "value", steps)
    return sc.zscore_transform(panel, stats, [], "value", "scaled").select("node", "t_idx", r6("scaled", 5).alias("scaled"))


@query(f"""WITH {PANEL_SQL}, {FIT_SQL}, s AS (SELECT node, min(value) AS lo, max(value) AS hi FROM fit GROUP BY node)
SELECT p.node, t_idx, {sql_r6('(value - lo) / nullif(hi - lo, 0)', 5)} AS scaled, {sql_r6('value', 5)} AS restored
FROM panel p LEFT JOIN s ON s.node = p.node""")
def minmax_transform(spark, sf_dir):
    panel, steps = _panel_and_steps(spark, sf_dir)
    stats = sc.minmax_fit(panel, ["node"], "value", steps)
    out = sc.minmax_transform(panel, stats, ["node"], "value", "scaled")
    out = sc.minmax_inverse(out, stats, ["node"], "scaled", "restored")
    return out.select("node", "t_idx", r6("scaled", 5).alias("scaled"), r6("restored", 5).alias("restored"))


@query(f"""WITH {PANEL_SQL}, {FIT_SQL}, s AS (SELECT node, avg(value) AS m,
 CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS d FROM fit GROUP BY node)
SELECT p.node, t_idx, {sql_r6('(value - m) / d', 5)} AS value, {sql_r6('value', 5)} AS value_unnorm FROM panel p LEFT JOIN s ON s.node = p.node""")
def rescale_policy(spark, sf_dir):
    panel, steps = _panel_and_steps(spark, sf_dir)
    stats = sc.zscore_fit(panel, ["node"], "value", steps)
    out = sc.rescale_policy(sc.zscore_transform(panel, stats, ["node"], "value"), stats, ["node"], ["value"], False)
    return out.select("node", "t_idx", r6("value", 5).alias("value"), r6("value_unnorm", 5).alias("value_unnorm"))


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_LONG = "lines AS (" + " UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '{c}' AS \"column\", {c} AS value FROM lineitem" for c in LINE_COLUMNS) + ")"
LOGGED = ["l_extendedprice", "l_quantity"]


def _lines(spark, sf_dir):
    """One row per line and measure, with the row's own keys."""
    return sc.to_long(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], LINE_COLUMNS)


@query(f"""WITH e AS (SELECT event_id, event_type, value FROM events),
q AS (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM e GROUP BY event_type)
SELECT event_id, {sql_r6('least(greatest(value, a), b)')} AS value FROM e JOIN q USING (event_type)""")
def winsorize(spark, sf_dir):
    out = sc.winsorize(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_id", r6("value").alias("value"))


@query(f"""WITH {LINE_LONG}, q AS (SELECT "column", quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
 stddev_samp(value) AS s FROM lines GROUP BY "column")
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "column", {sql_r6('(value - median) / (CASE WHEN iqr <> 0 THEN iqr WHEN s <> 0 THEN s ELSE 1 END)')} AS value
FROM lines JOIN q USING ("column")""")
def robust_scale(spark, sf_dir):
    out = sc.robust_scale(_lines(spark, sf_dir), ["column"], "value")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "column", r6("value").alias("value"))


@query(f"""WITH {LINE_LONG}, q AS (SELECT "column", min(value) AS a, max(value) AS b FROM lines GROUP BY "column")
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "column", {sql_r6('CASE WHEN b = a THEN 0 ELSE (value - a) / (b - a) END')} AS value
FROM lines JOIN q USING ("column")""")
def minmax_column(spark, sf_dir):
    out = sc.minmax_column(_lines(spark, sf_dir), ["column"], "value")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "column", r6("value").alias("value"))


CHAIN_SQL = f"""{LINE_LONG},
w AS (SELECT "column", quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM lines GROUP BY "column"),
clipped AS (SELECT l.* EXCLUDE (value), q01, q99, "column" IN ('l_extendedprice', 'l_quantity') AS log1p,
 CASE WHEN "column" IN ('l_extendedprice', 'l_quantity') THEN ln(1 + greatest(least(greatest(value, q01), q99), 0)) ELSE least(greatest(value, q01), q99) END AS v,
 least(greatest(value, q01), q99) AS clip_value FROM lines l JOIN w USING ("column")),
rb AS (SELECT "column", quantile_cont(v, 0.5) AS median, CASE WHEN quantile_cont(v, 0.75) <> quantile_cont(v, 0.25) THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25)
 WHEN stddev_samp(v) <> 0 THEN stddev_samp(v) ELSE 1 END AS iqr FROM clipped GROUP BY "column"),
scaled AS (SELECT c.*, median, iqr, (v - median) / iqr AS z FROM clipped c JOIN rb USING ("column")),
mm AS (SELECT "column", min(z) AS lo, max(z) AS hi FROM scaled GROUP BY "column")"""


@query(f"""WITH {CHAIN_SQL}
SELECT s."column", any_value(s.log1p) AS log1p, {', '.join(sql_r6(f'any_value(s.{c})') + f' AS {c}' for c in ('q01', 'q99', 'median', 'iqr'))},
 {sql_r6('any_value(mm.lo)')} AS "min", {sql_r6('any_value(mm.hi)')} AS "max" FROM scaled s JOIN mm USING ("column") GROUP BY s."column" """)
def chain_metadata(spark, sf_dir):
    meta = sc.fit_chain(_lines(spark, sf_dir), ["column"], "value", LOGGED, rescale_minmax=True)
    return meta.select("column", "log1p", *[r6(c).alias(c) for c in ("q01", "q99", "median", "iqr", "min", "max")])


@query(f"""WITH {CHAIN_SQL}
SELECT s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_suppkey, s."column", {sql_r6('CASE WHEN hi = lo THEN 0 ELSE (z - lo) / (hi - lo) END')} AS value
FROM scaled s JOIN mm USING ("column")""")
def transform_chain(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    meta = sc.fit_chain(lines, ["column"], "value", LOGGED, rescale_minmax=True)
    out = sc.apply_chain(lines, meta, ["column"], "value")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "column", r6("value").alias("value"))


@query(f"""WITH {CHAIN_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "column", {sql_r6('clip_value', 4)} AS value FROM scaled""")
def inverse_chain(spark, sf_dir):
    """Transformed and inverted: the winsorised original."""
    lines = _lines(spark, sf_dir)
    meta = sc.fit_chain(lines, ["column"], "value", LOGGED, rescale_minmax=True)
    out = sc.invert_chain(sc.apply_chain(lines, meta, ["column"], "value"), meta, ["column"], "value")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "column", r6("value", 4).alias("value"))


RUNS_SQL = f"""{PANEL_SQL}, marked AS (
 SELECT *, t_idx - row_number() OVER (PARTITION BY node, value IS NULL ORDER BY t_idx) AS island FROM panel),
runs AS (SELECT node, island, min(t_idx) AS start, count(*) AS n FROM marked WHERE value IS NULL GROUP BY node, island)"""


@query(f"""WITH {RUNS_SQL}, m AS (SELECT node, count(*) FILTER (WHERE value IS NULL) * 100.0 / count(*) AS rate FROM panel GROUP BY node)
SELECT m.node, {sql_r6('any_value(rate)')} AS missing_rate, CAST(coalesce(max(n), 0) AS BIGINT) AS max_consecutive,
 {sql_r6('coalesce(avg(n), 0)')} AS avg_consecutive, count(n) AS consecutive_gaps FROM m LEFT JOIN runs r ON r.node = m.node GROUP BY m.node""")
def missing_runs(spark, sf_dir):
    out = gaps.missing_runs(user_panel(spark, sf_dir, staged=True), ["node"], "t_idx", "value")
    return out.select("node", r6("missing_rate").alias("missing_rate"), "max_consecutive",
                      r6("avg_consecutive").alias("avg_consecutive"), "consecutive_gaps")


@query(f"""WITH {RUNS_SQL}
SELECT p.node, p.t_idx, {sql_r6('p.value')} AS value FROM panel p WHERE NOT EXISTS (
 SELECT 1 FROM runs r WHERE r.node = p.node AND r.n >= 3 AND p.t_idx >= r.start AND p.t_idx < r.start + r.n)""")
def drop_long_gaps(spark, sf_dir):
    out = gaps.drop_long_gaps(user_panel(spark, sf_dir, staged=True), ["node"], ["node"], "t_idx", "value", 3)
    return out.select("node", "t_idx", r6("value").alias("value"))


@query(f"""WITH s AS (SELECT user_id, count(value) AS n, avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY user_id)
SELECT event_id, {sql_r6('CASE WHEN n >= 10 AND abs((value - m) / nullif(d, 0)) > 2.5 THEN NULL ELSE value END')} AS value
FROM events JOIN s USING (user_id)""")
def outlier_zscore(spark, sf_dir):
    out = outliers.zscore_outliers(table(spark, sf_dir, "events"), ["user_id"], "value", 2.5)
    return out.select("event_id", r6("value").alias("value"))


@query(f"""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM events GROUP BY event_type)
SELECT event_id, {sql_r6('CASE WHEN abs((value - m) / nullif(d, 0)) > 3 THEN NULL ELSE value END')} AS value
FROM events JOIN s USING (event_type)""")
def outlier_zscore_population(spark, sf_dir):
    out = outliers.zscore_outliers(table(spark, sf_dir, "events"), ["event_type"], "value", 3, sample=False, min_count=0)
    return out.select("event_id", r6("value").alias("value"))


@query(f"""WITH q AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY user_id)
SELECT event_id, {sql_r6('CASE WHEN value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN NULL ELSE value END')} AS value
FROM events JOIN q USING (user_id)""")
def outlier_iqr(spark, sf_dir):
    out = outliers.iqr_outliers(table(spark, sf_dir, "events"), ["user_id"], "value", 1.5)
    return out.select("event_id", r6("value").alias("value"))


def sensor_text(spark, sf_dir):
    """Customer balances as raw sensor text: control characters, zeros and negatives.

    The market segments play the indicators, nations the stations.
    """
    text = F.concat(F.lit("\x01"), F.col("c_acctbal").cast("string"), F.lit("\t"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("station"), F.col("c_mktsegment").alias("indicator"), text.alias("raw"))


def segment_config(spark):
    """Physical ranges of the segments; FURNITURE is left unconfigured."""
    rows = [("AUTOMOBILE", 0.0, 9000.0), ("BUILDING", 500.0, 9500.0), ("HOUSEHOLD", 0.0, 5000.0), ("MACHINERY", 100.0, 9999.0)]
    return spark.createDataFrame(rows, "indicator string, min_val double, max_val double")


SEGMENT_SQL = "VALUES ('AUTOMOBILE', 0.0, 9000.0), ('BUILDING', 500.0, 9500.0), ('HOUSEHOLD', 0.0, 5000.0), ('MACHINERY', 100.0, 9999.0)"


@query(f"""WITH cfg(indicator, lo, hi) AS ({SEGMENT_SQL}),
raw AS (SELECT c_custkey, c_nationkey AS station, c_mktsegment AS indicator, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer),
st AS (SELECT station, indicator, count(v) AS n, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM raw GROUP BY station, indicator)
SELECT c_custkey, {sql_r6('''CASE WHEN lo IS NULL OR n <= 10 THEN v WHEN v < a - 0.5 * (b - a) OR v > b + 0.5 * (b - a) THEN NULL
 WHEN v < lo OR v > hi THEN NULL ELSE v END''')} AS value
FROM raw JOIN st USING (station, indicator) LEFT JOIN cfg USING (indicator)""")
def clean_values(spark, sf_dir):
    out = outliers.clean_values(
        sensor_text(spark, sf_dir), segment_config(spark), ["station", "indicator"], "raw", "iqr", 0.5)
    return out.select("c_custkey", r6("value").alias("value"))


NEAR_SQL = f"""{PANEL_SQL}, near AS (
 SELECT *, max(CASE WHEN value IS NOT NULL THEN t_idx END) OVER (PARTITION BY node ORDER BY t_idx) AS pt,
        min(CASE WHEN value IS NOT NULL THEN t_idx END) OVER (PARTITION BY node ORDER BY t_idx DESC) AS nt FROM panel),
ends AS (SELECT n.*, p.value AS pv, x.value AS nv FROM near n LEFT JOIN panel p ON p.node = n.node AND p.t_idx = n.pt
 LEFT JOIN panel x ON x.node = n.node AND x.t_idx = n.nt)"""


@query(f"""WITH {NEAR_SQL} SELECT node, t_idx, {sql_r6('coalesce(value, pv + (nv - pv) * (t_idx - pt) / nullif(nt - pt, 0), pv)')} AS value FROM ends""")
def interpolate_linear(spark, sf_dir):
    out = impute.interpolate_linear(user_panel(spark, sf_dir, staged=True), ["node"], "t_idx", "value")
    return out.select("node", "t_idx", r6("value").alias("value"))


@query(f"""WITH readings AS (SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN event_type <> 'error' THEN value END AS value FROM events),
near AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN us END) OVER (PARTITION BY user_id ORDER BY us) AS pu,
 min(CASE WHEN value IS NOT NULL THEN us END) OVER (PARTITION BY user_id ORDER BY us DESC) AS nu FROM readings),
ends AS (SELECT n.*, p.value AS pv, x.value AS nv FROM near n LEFT JOIN readings p ON p.user_id = n.user_id AND p.us = n.pu
 LEFT JOIN readings x ON x.user_id = n.user_id AND x.us = n.nu)
SELECT event_id, {sql_r6('coalesce(value, pv + (nv - pv) * (us - pu) / nullif(nu - pu, 0), pv, nv)')} AS value FROM ends""")
def interpolate_time(spark, sf_dir):
    """IMP2 on an uneven axis: every user's events as they came, an error being a missing reading."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", micros("ts").alias("us"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    out = impute.interpolate_time(rows, ["user_id"], "us", "ts", "value", chunk=None)
    return out.select("event_id", r6("value").alias("value"))


@query(f"WITH {NEAR_SQL} SELECT node, t_idx, {sql_r6('coalesce(value, pv, nv)')} AS value FROM ends")
def fill_both_ways(spark, sf_dir):
    out = impute.fill_both_ways(user_panel(spark, sf_dir, staged=True), ["node"], "t_idx", "value")
    return out.select("node", "t_idx", r6("value").alias("value"))


@query(f"""WITH RECURSIVE {PANEL_SQL},
pts AS (SELECT node AS s, t_idx::DOUBLE AS x, value AS y FROM panel WHERE value IS NOT NULL), {spline_sql("pts")}
SELECT v.node, v.t_idx, {sql_r6(f"coalesce(v.value, {cubic_sql('v.t_idx')})", 4)} AS value
FROM panel v LEFT JOIN pieces p ON v.value IS NULL AND {piece_on("v.node", "v.t_idx")}""")
def interpolate_cubic(spark, sf_dir):
    """IMP3; the twin solves the same system by recursion."""
    panel = stage(user_panel(spark, sf_dir).withColumn("_axis", F.col("t_idx").cast("double")))
    out = spline_values(panel, ["node"], "t_idx", "_axis", "value", "spline")
    return out.select("node", "t_idx", r6(F.coalesce("value", "spline"), 4).alias("value"))


TYPES = ["click", "error", "purchase", "signup", "view"]


def _daily_wide(spark, sf_dir):
    """Mean value per user and day, one column per event type; most cells are missing."""
    events = table(spark, sf_dir, "events")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("station"))
    day = F.floor(micros("ts") / F.lit(86_400_000_000)).cast("long")
    rows = events.join(customer, "user_id").select("station", (F.col("user_id") * 100_000 + day).alias("row"), "event_type", "value")
    return rows.groupBy("station", "row").pivot("event_type", TYPES).agg(F.avg("value"))


@query(f"""WITH wide AS (SELECT c_mktsegment AS station, user_id * 100000 + CAST(floor(epoch_us(ts) / 86400000000.0) AS BIGINT) AS "row",
 {', '.join(f"avg(value) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES)}
 FROM events JOIN customer ON c_custkey = user_id GROUP BY ALL),
st AS (SELECT station, {', '.join(f'avg({t}) AS m_{t}, CASE WHEN stddev_pop({t}) = 0 THEN 1 ELSE stddev_pop({t}) END AS s_{t}' for t in TYPES)} FROM wide GROUP BY station),
z AS (SELECT w.station, w."row", {', '.join(f'({t} - m_{t}) / s_{t} AS {t}' for t in TYPES)} FROM wide w JOIN st USING (station)),
pairs AS (SELECT a.station, a."row", b."row" AS donor,
 round(sqrt(5.0 / shared * total), 9) AS dist,
 {', '.join(f'CASE WHEN a_{t} IS NULL THEN b_{t} END AS d_{t}' for t in TYPES)}
 FROM (SELECT a.station, a."row", {', '.join(f'a.{t} AS a_{t}' for t in TYPES)} FROM z a WHERE {' OR '.join(f'a.{t} IS NULL' for t in TYPES)}) a
 JOIN (SELECT station AS st2, "row", {', '.join(f'{t} AS b_{t}' for t in TYPES)} FROM z) b ON b.st2 = a.station
 CROSS JOIN LATERAL (SELECT {' + '.join(f'CAST(a_{t} IS NOT NULL AND b_{t} IS NOT NULL AS INTEGER)' for t in TYPES)} AS shared,
  {' + '.join(f'coalesce((a_{t} - b_{t}) * (a_{t} - b_{t}), 0)' for t in TYPES)} AS total) WHERE shared > 0),
{', '.join(f'''f_{t} AS (SELECT station, "row", avg(v) AS v FROM (SELECT station, "row", d_{t} AS v,
 row_number() OVER (PARTITION BY station, "row" ORDER BY dist, donor) AS rn FROM pairs WHERE d_{t} IS NOT NULL) WHERE rn <= 5 GROUP BY station, "row")''' for t in TYPES)}
SELECT w.station, w."row", {', '.join(sql_r6(f'coalesce(w.{t}, coalesce(f_{t}.v, 0) * s_{t} + m_{t})', 5) + f' AS {t}' for t in TYPES)}
FROM wide w JOIN st ON st.station = w.station {' '.join(f'LEFT JOIN f_{t} ON f_{t}.station = w.station AND f_{t}."row" = w."row"' for t in TYPES)}""")
def knn_impute(spark, sf_dir):
    out = knn.knn_impute(stage(_daily_wide(spark, sf_dir)), ["station"], "row", TYPES)
    return out.select("station", "row", *[r6(t, 5).alias(t) for t in TYPES])


PROFILE = ("mean", "std", "min", "p01", "p05", "median", "p95", "p99", "max", "missing_ratio", "zero_ratio", "skew", "kurt")
PROFILE_SQL = """count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS "min", quantile_cont(value, 0.01) AS p01,
 quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99,
 max(value) AS "max", avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_ratio, count(*) FILTER (WHERE value = 0) * 1.0 / count(*) AS zero_ratio,
 skewness(value) AS skew, kurtosis(value) AS kurt"""


@query(f"""WITH {LINE_LONG}, p AS (SELECT "column", {PROFILE_SQL} FROM lines GROUP BY "column")
SELECT "column", count, {', '.join(sql_r6(f'"{c}"', 5) + f' AS "{c}"' for c in PROFILE)} FROM p""")
def column_profile(spark, sf_dir):
    out = pf.column_profile(table(spark, sf_dir, "lineitem"), LINE_COLUMNS)
    return out.select("column", "count", *[r6(c, 5).alias(c) for c in PROFILE])


@query(f"""WITH {PANEL_SQL}, p AS (SELECT node, {PROFILE_SQL} FROM panel GROUP BY node)
SELECT node, count, {', '.join(sql_r6(f'"{c}"', 5) + f' AS "{c}"' for c in PROFILE)} FROM p""")
def series_profile(spark, sf_dir):
    out = pf.summarize(user_panel(spark, sf_dir, staged=True), ["node"])
    return out.select("node", "count", *[r6(c, 5).alias(c) for c in PROFILE])


@query(f"""WITH cfg(indicator, lo, hi) AS ({SEGMENT_SQL}),
raw AS (SELECT c_mktsegment AS indicator, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v, CAST(round(c_acctbal * 100) AS HUGEINT) AS cents FROM customer)
SELECT indicator, count(*) AS total, count(*) FILTER (WHERE v IS NULL) AS missing, count(v) AS valid, {sql_r6('min(v)')} AS "min", {sql_r6('max(v)')} AS "max",
 ((sum(cents) FILTER (WHERE v IS NOT NULL) * 20000 + count(v)) // (2 * count(v)))::DOUBLE / 1e6 AS mean, {sql_r6('stddev_samp(v)')} AS std, count(*) FILTER (WHERE v < lo OR v > hi) AS out_of_range,
 {sql_r6('count(*) FILTER (WHERE v IS NULL) * 100.0 / count(*)')} AS missing_pct, count(*) FILTER (WHERE v < lo OR v > hi) = 0 AS in_range
FROM raw JOIN cfg USING (indicator) GROUP BY indicator""")
def quality_report(spark, sf_dir):
    """PR3 on cents: decimals are summed exactly, so a mean on a rounding tie is the same in every order."""
    rows = sensor_text(spark, sf_dir).withColumn("value", outliers.parse_sensor_text("raw").cast("decimal(18,2)"))
    out = pf.quality_report(rows, segment_config(spark))
    return out.select("indicator", "total", "missing", "valid", *[r6(c).alias(c) for c in ("min", "max", "mean", "std")],
                      "out_of_range", r6("missing_pct").alias("missing_pct"), "in_range")


@query(f"""WITH {RUNS_SQL}, kept AS (SELECT p.* FROM panel p WHERE NOT EXISTS (
 SELECT 1 FROM runs r WHERE r.node = p.node AND r.n >= 3 AND p.t_idx >= r.start AND p.t_idx < r.start + r.n)),
k AS (SELECT node, count(*) AS n FROM kept GROUP BY node)
SELECT p.node, count(*) AS rows_before, coalesce(any_value(k.n), 0) AS rows_after, {sql_r6('coalesce(any_value(k.n), 0) * 100.0 / count(*)')} AS retention_pct
FROM panel p LEFT JOIN k ON k.node = p.node GROUP BY p.node""")
def retention(spark, sf_dir):
    panel = user_panel(spark, sf_dir, staged=True)
    kept = gaps.drop_long_gaps(panel, ["node"], ["node"], "t_idx", "value", 3)
    return pf.retention(panel, kept, ["node"]).select(
        "node", "rows_before", "rows_after", r6("retention_pct").alias("retention_pct"))


@query(f"""SELECT count(*) FILTER (WHERE isnan(value)) > 0 AS has_nan, count(*) FILTER (WHERE isinf(value)) > 0 AS has_inf FROM (
 SELECT CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_discount END AS value FROM lineitem)""")
def finite_check(spark, sf_dir):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / F.nullif(F.col("l_discount"), F.lit(0.0)))
    return pn.check_finite(table(spark, sf_dir, "lineitem").select(ratio.alias("value")), "value")
