import pytest
from pyspark.sql import functions as F

from chronoloom.functions import calendar as cal
from chronoloom.operators.panel import with_calendar
from chronoloom.streaming.append import append_steps, rolling_windows
from chronoloom.streaming.meters import drain, running_meter

SCHEMA = "node string, ts timestamp_ntz, value double, n int"


def write(spark, path, rows):
    df = spark.createDataFrame(rows, "node string, s string, value double, n int")
    df.select("node", F.col("s").cast("timestamp_ntz").alias("ts"), "value", "n").coalesce(1).write.mode("append").parquet(path)


def windows_of(spark, path, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    return {r.node: r for r in drain(rolling_windows(stream, "node", 3, **options), ["node"]).collect()}


def test_windows_over_triggers(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("a", f"2024-01-01 0{h}:00:00", float(h), 1) for h in (2, 0, 1)] + [("b", "2024-01-01 00:00:00", 9.0, 1)])
    # the second file repeats a late hour, which must not enter the window again
    write(spark, path, [("a", f"2024-01-01 0{h}:00:00", float(h), 1) for h in (1, 3, 4)])
    got = windows_of(spark, path)
    assert set(got) == {"a"}
    assert got["a"].inputs == [2.0, 3.0, 4.0] and (got["a"].steps, got["a"].late) == (5, 0)


def test_steps_out_of_order_over_triggers(spark, tmp_path):
    """Every step finds its place, whichever trigger brings it; what is too old for a window is counted."""
    path = str(tmp_path / "in")
    for hours in ((8, 2), (5, 9), (7, 1), (6, 8, 0)):
        write(spark, path, [("a", f"2024-01-01 0{h}:00:00", float(h), 1) for h in hours] + [(None, "2024-01-01 00:00:00", 1.0, 1)])
    got = windows_of(spark, path, delay="9 hours")["a"]
    assert got.inputs == [7.0, 8.0, 9.0] and (got.steps, got.late, got.ended) == (8, 0, False)
    got = windows_of(spark, path, delay="1 hour")["a"]
    assert got.inputs == [7.0, 8.0, 9.0] and (got.steps, got.late) == (5, 3)


def test_idle_series_end(spark, tmp_path):
    """A series without steps for long emits its last row and leaves the state."""
    path = str(tmp_path / "in")
    write(spark, path, [("old", f"2024-01-01 0{h}:00:00", float(h), 1) for h in range(4)])
    write(spark, path, [("new", f"2024-03-01 0{h}:00:00", float(h), 1) for h in range(4)])
    write(spark, path, [("new", "2024-03-02 00:00:00", 9.0, 1), ("old", "2024-01-02 00:00:00", 5.0, 1)])
    write(spark, path, [("new", "2024-03-03 00:00:00", 8.0, 1), ("old", "2024-01-03 00:00:00", 6.0, 1)])
    got = windows_of(spark, path, idle="10 days")
    # the third file still came in time for the old series, the fourth did not
    assert got["old"].ended and got["old"].inputs == [2.0, 3.0, 5.0]
    assert not got["new"].ended and got["new"].inputs == [3.0, 9.0, 8.0]


def test_meter_over_triggers(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [("a", "2024-01-01 00:00:00", 2.0, 1)])
    write(spark, path, [("a", "2024-01-01 01:00:00", 4.0, 3)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    r = drain(running_meter(stream, ["node"], "value", "n"), ["node"]).first()
    assert (r.n, r.mean) == (4, 3.5) and r.rms == pytest.approx((52 / 4) ** 0.5)


def test_batch_append(spark):
    old = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "node int, t_idx long, value double")
    old = with_calendar(old.withColumn("ts", cal.from_micros(F.col("t_idx") * 3_600_000_000)), features=["tod"])
    new = spark.createDataFrame([(0, 1, 3.0), (0, 2, 4.0)], "node int, step long, value double")
    rows = append_steps(old, new, ["node"], 3_600_000_000).orderBy("t_idx").collect()
    assert [r.value for r in rows] == [1.0, 2.0, 3.0, 4.0]
    assert [r.ts.hour for r in rows] == [0, 1, 2, 3] and rows[3].tod == pytest.approx(3 / 24)
