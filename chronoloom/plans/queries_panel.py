"""Panels, calendar, splits and windows as named queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoloom.functions import arrays, calendar as cal, scalars
from chronoloom.operators import panel as pn, split as sp, timeaxis as ta, windows as wn
from chronoloom.session import checkpoint_root
from chronoloom.sources import description as ds, sinks
from chronoloom.plans.catalog import (
    IN_LEN, OUT_LEN, PANEL_SQL, RATIO, SAMPLES_SQL, STEP_US, TYPES_SQL, bounds_sql, query, r6, sql_r6, table,
    type_panel, user_axis, user_panel, user_samples,
)


@query(f"WITH {PANEL_SQL} SELECT node, t_idx, ts, {sql_r6('value')} AS value FROM panel")
def panel_users(spark, sf_dir):
    return user_panel(spark, sf_dir).select("node", "t_idx", "ts", r6("value").alias("value"))


@query(f"WITH {TYPES_SQL} SELECT node, t_idx, ts, {sql_r6('value')} AS value FROM types")
def panel_hourly(spark, sf_dir):
    return type_panel(spark, sf_dir).select("node", "t_idx", "ts", r6("value").alias("value"))


@query("""SELECT event_id, CAST(dense_rank() OVER (ORDER BY ts) - 1 AS BIGINT) AS t_idx FROM events""")
def time_index(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return events.join(ta.time_index(events, "ts"), "ts").select("event_id", "t_idx")


@query(f"""WITH {PANEL_SQL}, {bounds_sql()}
SELECT split, lo, hi, greatest(hi - lo - {IN_LEN + OUT_LEN} + 1, 0) AS samples FROM bounds""")
def split_bounds(spark, sf_dir):
    axis = user_axis(spark, sf_dir)
    return sp.bounds_table(spark, sp.split_bounds(axis.length, RATIO, IN_LEN, OUT_LEN), IN_LEN, OUT_LEN)


@query(f"""WITH {PANEL_SQL}, {bounds_sql(overlap='true')}
SELECT split, node, count(*) AS steps, count(value) AS present, {sql_r6('sum(value)', 4)} AS total, min(t_idx - lo) AS first_pos, max(t_idx - lo) AS last_pos
FROM panel JOIN bounds ON t_idx >= lo AND t_idx < hi GROUP BY split, node""")
def split_overlap(spark, sf_dir):
    axis = user_axis(spark, sf_dir)
    bounds = sp.split_bounds(axis.length, RATIO, IN_LEN, OUT_LEN, overlap=True)
    rows = sp.assign_splits(user_panel(spark, sf_dir, axis), bounds)
    return rows.groupBy("split", "node").agg(
        F.count(F.lit(1)).alias("steps"), F.count("value").alias("present"), r6(F.sum("value"), 4).alias("total"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(f"""SELECT event_id,
 {sql_r6("(epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400000000.0")} AS tod,
 {sql_r6('(hour(ts) * 60 + minute(ts)) / 1440.0')} AS tod_minute,
 {sql_r6('(isodow(ts) - 1) / 7.0')} AS dow, {sql_r6('(day(ts) - 1) / 31.0')} AS dom, {sql_r6('(dayofyear(ts) - 1) / 366.0')} AS doy,
 {sql_r6('(isodow(ts) - 1) / 7.0 - 0.5')} AS dow_centred,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, date_trunc('second', ts) AS reread
FROM events""")
def calendar_ts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    out = pn.with_calendar(events)
    stamp = cal.format_time("ts")
    return out.select(
        "event_id", r6("tod").alias("tod"), r6(cal.time_of_day_minutes("ts")).alias("tod_minute"),
        r6("dow").alias("dow"), r6("dom").alias("dom"), r6("doy").alias("doy"),
        r6(cal.centred("dow")).alias("dow_centred"), stamp.alias("stamp"), cal.parse_time(stamp).alias("reread"))


@query(f"""WITH {TYPES_SQL}
SELECT node, t_idx, {sql_r6('(t_idx % 24) / 24.0')} AS tod, {sql_r6('((t_idx // 24) % 7) / 7.0')} AS dow FROM types""")
def calendar_index(spark, sf_dir):
    return pn.with_index_calendar(type_panel(spark, sf_dir), 24).select(
        "node", "t_idx", r6("tod").alias("tod"), r6("dow").alias("dow"))


@query(f"""WITH {PANEL_SQL}
SELECT node, CAST(k AS INTEGER) AS step, last_ts + to_microseconds(k * {STEP_US}) AS ts
FROM (SELECT node, max(ts) AS last_ts FROM panel GROUP BY node) CROSS JOIN (SELECT unnest(range(1, 5)) AS k)""")
def future_timestamps(spark, sf_dir):
    return pn.future_timestamps(user_panel(spark, sf_dir), ["node"], "ts", STEP_US, 4)


@query(f"""WITH {PANEL_SQL} SELECT CAST((min(ts2) - min(ts1)) / 60000000 AS INTEGER) AS minutes, min(n) AS series FROM (
 SELECT min(epoch_us(ts)) AS ts1, (SELECT min(epoch_us(ts)) FROM panel WHERE t_idx = 1) AS ts2, count(DISTINCT node) AS n FROM panel)""")
def frequency(spark, sf_dir):
    """CAL8 on the stamps of the panel, next to the number of series."""
    panel = user_panel(spark, sf_dir)
    minutes = pn.infer_frequency_minutes(panel.select("ts").distinct(), "ts")
    return panel.agg(F.countDistinct("node").alias("series")).select(F.lit(minutes).cast("int").alias("minutes"), "series")


@query(f"""WITH {SAMPLES_SQL}
SELECT a.split, a.node, a.pos AS sample_id, k.k AS slot, {sql_r6('b.value')} AS value
FROM rows_in a CROSS JOIN (SELECT unnest(range({IN_LEN + OUT_LEN})) AS k) k
JOIN rows_in b ON b.split = a.split AND b.node = a.node AND b.pos = a.pos + k.k
WHERE a.pos + {IN_LEN + OUT_LEN} <= a.len""")
def sliding_windows(spark, sf_dir):
    both = user_samples(spark, sf_dir).withColumn("all", F.concat("inputs", "target"))
    rows = both.select("split", "node", "sample_id", F.posexplode("all").alias("slot", "value"))
    return rows.select("split", "node", "sample_id", F.col("slot").cast("long").alias("slot"), r6("value").alias("value"))


@query(f"""WITH {PANEL_SQL}
SELECT node, t_idx - (steps - {IN_LEN}) AS slot, {sql_r6('value')} AS value, NULL::TIMESTAMP AS future_ts
FROM panel CROSS JOIN panel_lim WHERE t_idx >= steps - {IN_LEN}
UNION ALL
SELECT node, {IN_LEN} + k AS slot, NULL, max(ts) + to_microseconds((k + 1) * {STEP_US})
FROM panel CROSS JOIN (SELECT unnest(range({OUT_LEN})) AS k) GROUP BY node, k""")
def last_window(spark, sf_dir):
    axis = user_axis(spark, sf_dir)
    rows = wn.last_window(
        user_panel(spark, sf_dir, axis), ["node"], "t_idx", "ts", "value", IN_LEN, OUT_LEN, STEP_US, axis.length - 1)
    past = rows.select("node", F.posexplode("inputs").alias("slot", "value")).withColumn(
        "future_ts", F.lit(None).cast("timestamp_ntz"))
    ahead = rows.select("node", F.posexplode("future_ts").alias("slot", "future_ts")).withColumn(
        "slot", F.col("slot") + IN_LEN).withColumn("value", F.lit(None).cast("double"))
    both = past.unionByName(ahead)
    return both.select("node", F.col("slot").cast("long").alias("slot"), r6("value").alias("value"), "future_ts")


@query(f"""WITH {SAMPLES_SQL}
SELECT a.split, a.node, a.pos AS sample_id, p.p AS patch, k.k AS slot, {sql_r6('b.value')} AS value
FROM rows_in a CROSS JOIN (SELECT unnest(range(3)) AS p) p CROSS JOIN (SELECT unnest(range(4)) AS k) k
JOIN rows_in b ON b.split = a.split AND b.node = a.node AND b.pos = a.pos + 2 * p.p + k.k
WHERE a.pos + {IN_LEN + OUT_LEN} <= a.len""")
def patches(spark, sf_dir):
    rows = wn.with_patches(user_samples(spark, sf_dir), "inputs", IN_LEN, 4, 2)
    rows = rows.select("split", "node", "sample_id", F.posexplode("patches").alias("patch", "_p"))
    rows = rows.select("split", "node", "sample_id", "patch", F.posexplode("_p").alias("slot", "value"))
    return rows.select("split", "node", "sample_id", F.col("patch").cast("long").alias("patch"),
                       F.col("slot").cast("long").alias("slot"), r6("value").alias("value"))


@query(f"""WITH {SAMPLES_SQL},
marked AS (SELECT r.*, ((r.pos + b.lo) % 4) / 4.0 - 0.5 AS mark FROM rows_in r JOIN bounds b ON b.split = r.split)
SELECT a.split, a.node, a.pos AS sample_id, k.k AS slot,
       {sql_r6(f'CASE WHEN k.k < 3 THEN b.value ELSE 0 END')} AS x_dec, {sql_r6('b.mark')} AS mark_dec
FROM marked a CROSS JOIN (SELECT unnest(range({3 + OUT_LEN})) AS k) k
JOIN marked b ON b.split = a.split AND b.node = a.node AND b.pos = a.pos + {IN_LEN - 3} + k.k
WHERE a.pos + {IN_LEN + OUT_LEN} <= a.len""")
def decoder_layout(spark, sf_dir):
    axis = user_axis(spark, sf_dir)
    panel = pn.with_index_calendar(user_panel(spark, sf_dir, axis), 4)
    rows = sp.assign_splits(panel, sp.split_bounds(axis.length, RATIO, IN_LEN, OUT_LEN))
    samples = wn.sliding_windows(rows, ["split", "node"], "pos", ["value", "tod"], IN_LEN, OUT_LEN)
    out = wn.decoder_layout(samples, IN_LEN, OUT_LEN, 3, ["tod"])
    pairs = F.arrays_zip(F.col("x_dec").alias("x"), F.col("tod_mark_dec").alias("m"))
    out = out.select("split", "node", "sample_id", F.posexplode(pairs).alias("slot", "_x"))
    return out.select("split", "node", "sample_id", F.col("slot").cast("long").alias("slot"),
                      r6("_x.x").alias("x_dec"), r6("_x.m").alias("mark_dec"))


@query(f"""WITH {SAMPLES_SQL}, w AS (
 SELECT split, node, pos AS sample_id, len, {', '.join(f'lead(value, {k}) OVER w AS v{k}' for k in range(IN_LEN))}
 FROM rows_in WINDOW w AS (PARTITION BY split, node ORDER BY pos)),
l AS (SELECT split, node, sample_id, k.k AS slot, CASE k.k {' '.join(f'WHEN {k} THEN v{k}' for k in range(IN_LEN))} END AS value
      FROM w CROSS JOIN (SELECT unnest(range({IN_LEN})) AS k) k WHERE sample_id + {IN_LEN + OUT_LEN} <= len),
s AS (SELECT *, avg(value) OVER p AS centre, sqrt(var_pop(value) OVER p + 1e-5) AS spread FROM l
      WINDOW p AS (PARTITION BY split, node, sample_id))
SELECT split, node, sample_id, slot, {sql_r6('centre')} AS centre, {sql_r6('spread')} AS spread,
       {sql_r6('(value - centre) / spread')} AS normed, {sql_r6('value')} AS restored FROM s""")
def instance_norm(spark, sf_dir):
    s = arrays.instance_stats(user_samples(spark, sf_dir), "inputs").withColumn(
        "_normed", arrays.instance_norm("inputs"))
    s = s.withColumn("_restored", arrays.instance_denorm("_normed"))
    pairs = F.arrays_zip(F.col("_normed").alias("n"), F.col("_restored").alias("r"))
    s = s.select("split", "node", "sample_id", "centre", "spread", F.posexplode(pairs).alias("slot", "_x"))
    return s.select("split", "node", "sample_id", F.col("slot").cast("long").alias("slot"), r6("centre").alias("centre"),
                    r6("spread").alias("spread"), r6("_x.n").alias("normed"), r6("_x.r").alias("restored"))


@query(f"""WITH {PANEL_SQL}
SELECT 'users' AS name, steps AS num_time_steps, (SELECT count(DISTINCT node) FROM panel) AS num_nodes, 2 AS num_features, CAST(360 AS DOUBLE) AS minutes FROM panel_lim""")
def description(spark, sf_dir):
    """DS2."""
    out = ds.describe(user_panel(spark, sf_dir), "users", "events", ["value", "tod"], 4)
    return out.select("name", "num_time_steps", "num_nodes", "num_features", F.col("frequency (minutes)").alias("minutes"))


@query(f"""WITH {PANEL_SQL} SELECT node, t_idx, {sql_r6('value')} AS value FROM panel
WHERE node IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def series_subset(spark, sf_dir):
    """PRJ4: the series of a table of nodes."""
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))
    return pn.select_series(user_panel(spark, sf_dir), chosen).select("node", "t_idx", r6("value").alias("value"))


@query(f"""WITH {PANEL_SQL} SELECT node, t_idx, {sql_r6('value')} AS value FROM panel WHERE t_idx < 80""")
def first_steps(spark, sf_dir):
    """PRJ5: the first twenty days of every series."""
    return pn.first_steps(user_panel(spark, sf_dir), 20 * 4).select("node", "t_idx", r6("value").alias("value"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g')) AS kept, md5(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g')) AS digest FROM documents""")
def strip_control(spark, sf_dir):
    """PRJ8 on whole documents."""
    clean = scalars.strip_control("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(clean).cast("long").alias("kept"), F.md5(clean).alias("digest"))


@query(f"""WITH n AS (SELECT event_id, TRY_CAST(trim(regexp_replace(props, '[^0-9.]', '', 'g')) AS DOUBLE) AS k, value FROM events)
SELECT event_id, {sql_r6('CASE WHEN k > 0 THEN k END')} AS positive, {sql_r6('CASE WHEN k BETWEEN 10 AND 90 THEN k END')} AS inside,
 {sql_r6('CASE WHEN value < 10 THEN 10 WHEN value > 100 THEN 100 ELSE value END')} AS clipped, {sql_r6('round_even(value, 1)')} AS rounded,
 {sql_r6('ln(1 + greatest(value, 0))')} AS logged FROM n""")
def scalar_cleaning(spark, sf_dir):
    """PRJ9-PRJ13, MTH1 side by side."""
    k = scalars.to_number(F.regexp_replace("props", "[^0-9.]", ""))
    return table(spark, sf_dir, "events").select(
        "event_id", r6(scalars.positive_or_null(k)).alias("positive"),
        r6(scalars.in_range_or_null(k, F.lit(10.0), F.lit(90.0))).alias("inside"),
        r6(scalars.clip("value", F.lit(10.0), F.lit(100.0))).alias("clipped"), r6(scalars.round_to("value", 1)).alias("rounded"),
        r6(scalars.log1p_clamped("value")).alias("logged"))


@query(f"""WITH {PANEL_SQL}, {bounds_sql()}
SELECT split, node, t_idx, {sql_r6('value')} AS value FROM panel JOIN bounds ON t_idx >= lo AND t_idx < hi""")
def parquet_round_trip(spark, sf_dir):
    """SNK1: written by split, clustered by node, and read back."""
    axis = user_axis(spark, sf_dir)
    rows = sp.assign_splits(user_panel(spark, sf_dir, axis), sp.split_bounds(axis.length, RATIO, IN_LEN, OUT_LEN))
    path = f"{checkpoint_root(spark)}/series-{uuid.uuid4().hex}"
    sinks.write_series(rows, path)
    return spark.read.parquet(path).select("split", "node", "t_idx", r6("value").alias("value"))
