import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import calendar as cal
from chronoloom.operators import graph as gr, profile as pf, scalers as sc
from chronoloom.sources import description as ds, sinks, tables, tensor


@pytest.mark.parametrize("steps", [None, 1, 3])
def test_raw_tensor(spark, tmp_path, steps):
    x = np.arange(24, dtype=np.float32).reshape(4, 3, 2)
    (tmp_path / "data.dat").write_bytes(x.tobytes())
    df = tensor.read_tensor(spark, str(tmp_path / "data.dat"), (4, 3, 2), steps=steps)
    got = {(r.t_idx, r.node): r.channels for r in df.collect()}
    assert len(got) == 12 and got[2, 1] == x[2, 1].tolist()
    part = tensor.read_tensor(spark, str(tmp_path / "data.dat"), (4, 3, 2), t_lo=1, t_hi=3, steps=steps)
    assert sorted({r.t_idx for r in part.collect()}) == [1, 2]
    named = tensor.named_channels(df, ["value", "tod"]).where("t_idx = 3 and node = 2").first()
    assert (named.value, named.tod) == (22.0, 23.0)
    with pytest.raises(Exception, match="bytes"):
        tensor.read_tensor(spark, str(tmp_path / "data.dat"), (5, 3, 2)).collect()


def test_numpy_tensors(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(600, 2, 3))
    np.save(tmp_path / "a.npy", x)
    np.savez_compressed(tmp_path / "a.npz", data=x.astype(np.float32))
    for name in ("a.npy", "a.npz"):
        df = tensor.read_tensor(spark, str(tmp_path / name), steps=100)
        assert df.count() == 1200
        r = df.where("t_idx = 555 and node = 1").first()
        assert r.channels == pytest.approx(x[555, 1].tolist(), rel=1e-6)
        assert tensor.read_tensor(spark, str(tmp_path / name), t_lo=590).count() == 20
    np.save(tmp_path / "flat.npy", np.arange(5))
    assert [r.channels for r in tensor.read_tensor(spark, str(tmp_path / "flat.npy")).orderBy("t_idx").collect()] == [[float(i)] for i in range(5)]


def test_description(spark, tmp_path):
    (tmp_path / "b" / "x").mkdir(parents=True)
    (tmp_path / "b" / "bad").mkdir()
    desc = {"name": "x", "shape": [100, 2, 3], "regular_settings": {"INPUT_LEN": 12, "NULL_VAL": float("nan"), "TRAIN_VAL_TEST_RATIO": [0.6, 0.2, 0.2]}}
    (tmp_path / "b" / "x" / "desc.json").write_text(json.dumps(desc, indent=2))
    (tmp_path / "b" / "bad" / "desc.json").write_text("not a json")
    folders = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert ds.read_description(spark, folders, "x").first().shape == [100, 2, 3]
    settings = ds.read_settings(spark, folders, "x")
    assert settings.INPUT_LEN == 12 and settings.NULL_VAL != settings.NULL_VAL
    with pytest.raises(FileNotFoundError):
        ds.read_description(spark, folders, "missing")
    with pytest.raises(ValueError):
        ds.read_description(spark, folders, "bad")


def test_describe(spark, tmp_path):
    df = spark.range(48).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("node"), F.col("id").alias("t_idx"))
    out = ds.describe(df, "d", "traffic", ["value", "tod"], 288, settings={"INPUT_LEN": 12, "NULL_VAL": 0.0})
    r = out.first()
    assert r.shape == [48, 3, 2] and r["frequency (minutes)"] == 5.0 and r.regular_settings.INPUT_LEN == 12
    ds.write_description(out, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["num_nodes"] == 3


def test_wide_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("date,a,b\n2016/7/1 0:00,1.5,2\n2016/7/1 1:00,x,3\n")
    rows = tables.read_wide_csv(spark, str(tmp_path / "e.csv"), "yyyy/M/d H:mm").collect()
    got = {(str(r.ts), r.node): r.value for r in rows}
    assert got["2016-07-01 00:00:00", "a"] == 1.5 and got["2016-07-01 01:00:00", "a"] is None


def test_mixed_encodings(spark, tmp_path):
    text = "DATE,水温,pH\n2024-01-01 00:00:00,12.5\x01,7\n2024-01-01 04:00:00,坏,8\n"
    for name, encoding in (("s1", "utf-8"), ("s2", "gbk"), ("s3", "utf-8-sig")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    df = tables.read_sensor_csv(spark, str(tmp_path), {"水温": "water_temp"})
    got = {(r.station, r.ts.hour, r.indicator): r.raw for r in df.collect()}
    assert len(got) == 12
    for station in ("s1", "s2", "s3"):
        assert got[station, 0, "water_temp"] == "12.5\x01" and got[station, 4, "water_temp"] == "坏"
    chosen = {r.station: r.encoding for r in df.collect()}
    assert chosen == {"s1": "utf-8", "s2": "gbk", "s3": "utf-8"}


def test_encodings_are_judged_to_the_end(spark, tmp_path):
    """A byte far into a file decides, headers may be long and differ, many tasks read one file."""
    head = "DATE," + ",".join(f"指标{k}" for k in range(900))
    assert len(head.encode("gbk")) > 5000
    rows = [f"2024-01-01 0{k % 9}:00:00," + ",".join(["1"] * 900) for k in range(40)]
    (tmp_path / "long.csv").write_bytes((head + "\r\n" + "\r\n".join(rows) + "\r\n").encode("gbk"))
    plain = "DATE,a,b\n" + "2024-01-01 00:00:00,1,2\n" * 3000
    (tmp_path / "late.csv").write_bytes(plain.encode() + "2024-01-02 00:00:00,水温,\"x,\"\"y\"\n\n".encode("gbk"))
    (tmp_path / "odd.csv").write_bytes(b"a,DATE\n\xff\xff,2024-01-01 00:00:00\n7\n")
    (tmp_path / "bare.csv").write_bytes(b"DATE,a\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = tables.read_sensor_csv(spark, str(tmp_path), {"a": "first"}).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {}
    for r in got:
        by.setdefault(r.station, []).append(r)
    assert {k: {r.encoding for r in v} for k, v in by.items()} == {"long": {"gbk"}, "late": {"gbk"}, "odd": {"latin-1"}}
    assert len(by["long"]) == 36_000 and {r.indicator for r in by["long"]} == {f"指标{k}" for k in range(900)}
    assert len(by["late"]) == 6002
    assert {(r.indicator, r.raw) for r in by["late"] if r.ts.day == 2} == {("first", "水温"), ("b", 'x,"y')}
    assert sorted((r.raw, r.ts is None) for r in by["odd"]) == [("7", True), ("ÿÿ", False)]


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.csv").write_text("".join(f"{k},{k + 1},2\n" for k in range(500)))
    (tmp_path / "in" / "a.csv").write_text("from,to,cost\n" + "".join(f"{k},{k + 1},1\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        lines = tables.file_lines(spark, str(tmp_path / "in")).orderBy("line").collect()
        edges = gr.symmetric_edges(tables.read_edges(spark, str(tmp_path / "in"))).where("src = 7 AND dst = 8").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in lines] == list(range(3501)) and lines[3001].value == "0,1,2" and lines[1].value == "0,1,1"
    assert edges.distance == 2.0  # the later file wins


def test_archive_members_are_read_by_range(spark, tmp_path):
    x, y = np.arange(6000, dtype=np.float64).reshape(1000, 3, 2), np.arange(50, dtype=np.float32).reshape(50, 1)
    np.savez(tmp_path / "plain.npz", data=x, other=y)
    np.savez_compressed(tmp_path / "small.npz", data=x)
    for name, tasks in (("plain", 10), ("small", 1)):
        df = tensor.read_tensor(spark, str(tmp_path / f"{name}.npz"), steps=100, t_lo=5, t_hi=995)
        assert df.rdd.getNumPartitions() == tasks
        rows = df.orderBy("t_idx", "node").collect()
        assert len(rows) == 990 * 3 and rows[0].t_idx == 5
        assert np.array([r.channels for r in rows]).reshape(990, 3, 2).tolist() == x[5:995].tolist()
    assert tensor.read_tensor(spark, str(tmp_path / "plain.npz"), member="other").count() == 50


def test_timeseries_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp,v\n2024-01-02,1\nbad,2\n")
    df = tables.read_timeseries_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes)["timestamp"] == "timestamp_ntz"
    assert [r.timestamp is None for r in df.orderBy("v").collect()] == [False, True]


def test_inference_input(spark, tmp_path):
    lines = [["2024-01-01 00:00:00", 1.0, 2.0], ["2024-01-01 00:05:00", 3.0, 4.0]]
    (tmp_path / "i.csv").write_text("\n".join(",".join(map(str, r)) for r in lines))
    for data in (str(tmp_path / "i.csv"), lines):
        got = {(r.ts.minute, r.node): r.value for r in tables.read_inference(spark, data, 2).collect()}
        assert got == {(0, 0): 1.0, (0, 1): 2.0, (5, 0): 3.0, (5, 1): 4.0}
    with pytest.raises(ValueError):
        tables.read_inference(spark, lines, 3)


def test_classification_sets(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(4, 3, 2)
    for part in ("train", "test"):
        np.save(tmp_path / f"{part}_inputs.npy", x)
        np.save(tmp_path / f"{part}_labels.npy", np.array([0, 1, 0, 2]))
    rows = tables.read_classification(spark, str(tmp_path), "valid", archive=True).orderBy("sample_id").collect()
    assert [r.label for r in rows] == [0, 1, 0, 2] and rows[1].features == x[1].tolist()
    with pytest.raises(ValueError):
        tables.read_classification(spark, str(tmp_path), "nope")


def test_edge_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("from,to,cost\n10,20,1.5\n20,10,2.5\nbroken,row\n30,10,4\n")
    (tmp_path / "ids.txt").write_text("30\n10\n20\n")
    edges, ids = tables.read_edges(spark, str(tmp_path / "e.csv")), tables.read_node_ids(spark, str(tmp_path / "ids.txt"))
    assert edges.count() == 3
    got = {(r.src, r.dst): r.distance for r in gr.symmetric_edges(gr.map_ids(edges, ids)).collect()}
    assert got == {(1, 2): 2.5, (2, 1): 2.5, (0, 1): 4.0, (1, 0): 4.0}
    (tmp_path / "meta.csv").write_text("ID,lat\n1,2.5\n")
    assert tables.read_meta(spark, str(tmp_path / "meta.csv")).first().lat == 2.5


def test_metric_tables(spark, tmp_path):
    assert tables.read_metric_tables(spark, str(tmp_path)).count() == 0
    folder = tmp_path / "m1" / "evaluation"
    folder.mkdir(parents=True)
    head = "feature,count_less_5,count_less_10,samples_count,per_less_5,per_less_10,nse_val,rmse_val,nrmse_val,r2_val\n"
    (folder / "val_metrics_unnorm.csv").write_text(head + "a,1,2,10,0.1,0.2,-0.5,1,0.7,-0.5\n")
    df = tables.read_metric_tables(spark, str(tmp_path))
    r = pf.diagnose(df).first()
    assert (r.model, r.split, len(r.issues)) == ("m1", "val", 4)


def test_series_and_csv(spark, tmp_path):
    df = spark.range(10).select(F.lit("d").alias("dataset"), F.when(F.col("id") < 7, "train").otherwise("test").alias("split"),
                                F.lit(0).alias("node"), F.col("id").alias("t_idx"), (F.col("id") / 3).alias("value"))
    sinks.write_series(df, str(tmp_path / "s"), salt_steps=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("split = 'train'").count() == 7
    stamped = df.select(cal.from_micros(F.col("t_idx") * 60_000_000).alias("date"), "value")
    sinks.write_csv(stamped, str(tmp_path / "c"), order=["date"])
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect() if not r.value.startswith("date"))
    assert lines[1] == "1970-01-01 00:01:00,0.333333"


def test_meta_sidecar(spark, tmp_path):
    df = spark.createDataFrame([("x", float(i)) for i in range(50)], "column string, value double")
    meta = sc.fit_chain(df, ["column"], "value", ["x"], rescale_minmax=True)
    sinks.write_transform_meta(meta, str(tmp_path / "m"))
    raw = json.loads(spark.read.text(str(tmp_path / "m")).first().value)
    assert set(raw) == {"column", "winsor", "log1p", "robust", "minmax"}
    back = sinks.read_transform_meta(spark, str(tmp_path / "m"))
    out = sc.invert_chain(sc.apply_chain(df, back, ["column"], "value"), back, ["column"], "value")
    assert out.agg(F.max("value")).first()[0] == pytest.approx(48.51)


def test_forecast_outputs(spark, tmp_path):
    df = spark.createDataFrame(
        [("train", 0, 1, 0, 0, 1.0, 2.0), ("train", 0, 1, 1, 0, 3.0, 4.0), ("test", 0, 1, 0, 0, 5.0, 6.0)],
        "split string, sample_id int, step int, node int, channel int, prediction double, target double")
    sinks.write_forecast(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("split = 'train'").count() == 2
    sinks.write_results(df.where("split = 'train'"), str(tmp_path / "r"), "node", [0, 1])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "r")).collect()] == [("2.0", "1.0", "4.0", "3.0")]
    from chronoloom.operators import metrics as mt

    sinks.write_metrics(mt.horizon_metrics(df, [1], ["MAE"], ["split"]), str(tmp_path / "m"))
    got = {r.split: r.scopes for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert json.loads(got["train"]["overall"])["MAE"] == 1.0
    future = spark.createDataFrame([("2024-01-01 00:00:00", n, float(n)) for n in (0, 1)], "s string, node int, value double")
    future = future.select(F.col("s").cast("timestamp_ntz").alias("ts"), "node", "value")
    sinks.write_future(future, str(tmp_path / "x"), [0, 1])
    assert spark.read.text(str(tmp_path / "x")).first().value == "2024-01-01 00:00:00,0.0,1.0"


def test_dataset_report(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,v\n2024-01-01,1\n")
    report = pf.dataset_report(
        spark, {"a": str(tmp_path / "a.csv"), "gone": str(tmp_path / "gone.csv")}, lambda p: tables.read_timeseries_csv(spark, p))
    got = {r.name: r for r in report.collect()}
    assert (got["a"].num_rows, got["a"].numeric_columns) == (1, ["v"]) and got["gone"].error == "file not found"
    sinks.write_dataset_report(report, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_graph_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(0, 1, 1.0)], "src int, dst int, weight double")

    for _ in range(2):
        assert sinks.write_graph(spark, str(tmp_path / "g"), build).count() == 1
    assert len(calls) == 1
