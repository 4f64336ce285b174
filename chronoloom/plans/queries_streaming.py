"""Streaming operators and file round trips as named queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chronoloom.operators import metrics as mt
from chronoloom.plans.catalog import PANEL_SQL, STEP_US, query, r6, sql_r6, table, user_panel
from chronoloom.session import checkpoint_root
from chronoloom.sources import sinks, tables
from chronoloom.streaming.append import append_steps, rolling_windows
from chronoloom.streaming.meters import drain, running_meter


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY user_id) AS steps,
 max(epoch_us(ts)) OVER (PARTITION BY user_id) AS last_us FROM events)
SELECT user_id, steps, last_us, 8 - back AS slot, {sql_r6('value')} AS value FROM r WHERE back <= 8 AND steps >= 8""")
def stream_windows(spark, sf_dir):
    """STR1: the last eight values of every user, kept by a stream."""
    out = drain(rolling_windows(event_stream(spark, sf_dir), "user_id", 8), ["user_id"])
    rows = out.select("user_id", "steps", "last_us", F.posexplode("inputs").alias("slot", "value"))
    return rows.withColumn("slot", F.col("slot").cast("long")).withColumn("value", r6("value"))


METER_SQL = f"""WITH w AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events)
SELECT event_type, CAST(sum(n) AS BIGINT) AS n, {sql_r6('sum(value * n) / sum(n)')} AS mean, {sql_r6('sqrt(sum(value * value * n) / sum(n))')} AS rms FROM w GROUP BY event_type"""


def _weighted(events):
    return events.select("event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("n"))


@query(METER_SQL)
def stream_meter(spark, sf_dir):
    """STR2: running weighted means."""
    out = drain(running_meter(_weighted(event_stream(spark, sf_dir)), ["event_type"], "value", "n"), ["event_type"])
    return out.select("event_type", "n", r6("mean").alias("mean"), r6("rms").alias("rms"))


@query(METER_SQL)
def batch_meter(spark, sf_dir):
    """MET13 on the same rows in batch."""
    rows = _weighted(table(spark, sf_dir, "events"))
    mean = mt.meter(rows, ["event_type"]).withColumnRenamed("value", "mean")
    rms = mt.meter(rows, ["event_type"], squared=True).select("event_type", F.col("value").alias("rms"))
    return mean.join(rms, "event_type").select("event_type", "n", r6("mean").alias("mean"), r6("rms").alias("rms"))


@query(f"""WITH {PANEL_SQL}, lim AS (SELECT steps FROM panel_lim), old AS (SELECT node, t_idx, ts, value FROM panel),
added AS (SELECT p.node, p.t_idx + steps AS t_idx, p.ts + to_microseconds(CAST(steps * {STEP_US} AS BIGINT)) AS ts, p.value FROM panel p CROSS JOIN lim)
SELECT node, t_idx, ts, {sql_r6("(epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 86400000000.0")} AS tod, {sql_r6('value')} AS value
FROM (SELECT * FROM old UNION ALL SELECT * FROM added)""")
def append_batch(spark, sf_dir):
    """STR1 in batch: the panel's own values once more, after its end."""
    from chronoloom.operators.panel import with_calendar

    panel = user_panel(spark, sf_dir)
    new = panel.select("node", (F.col("t_idx") + 1).alias("step"), "value")
    out = append_steps(with_calendar(panel, features=["tod"]), new, ["node"], STEP_US)
    return out.select("node", "t_idx", "ts", r6("tod").alias("tod"), r6("value").alias("value"))


@query(f"WITH {PANEL_SQL} SELECT node, ts AS \"date\", {sql_r6('value', 4)} AS value FROM panel")
def csv_round_trip(spark, sf_dir):
    """SNK3, SRC6: written as text with six decimals and read back."""
    path = f"{checkpoint_root(spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(user_panel(spark, sf_dir).select("node", F.col("ts").alias("date"), "value"), path)
    back = tables.read_timeseries_csv(spark, path)
    return back.select(F.col("node").cast("long").alias("node"), "date", r6("value", 4).alias("value"))
