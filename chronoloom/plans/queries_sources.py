"""Files in foreign forms and small operators as named queries: driver tables are written, and read back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions import scalars
from chronoloom.functions.calendar import TIME_FORMAT
from chronoloom.operators import (
    evaluate as ev, forecast as fc, graph as gr, metrics as mt, panel as pn, profile as pf, scalers as sc, split as sp,
    windows as wn)
from chronoloom.operators.skew import partitions_for, spread_if_many
from chronoloom.plans import cleaning as cl, forecasting as fg
from chronoloom.plans.catalog import (
    FORECAST_SQL, IN_LEN, OUT_LEN, PANEL_SQL, RATIO, SAMPLES_SQL, TYPES_SQL, bounds_sql, query, r6, sql_r6, table, type_panel,
    user_axis, user_forecast, user_panel, user_samples)
from chronoloom.plans.queries_forecast import (
    FILLED_SQL, TYPES, _filled, _filled_samples, fill_sql, knn_sql, sensor_config, sensor_panel, stations_sql, window_mean)
from chronoloom.plans.queries_metrics import M
from chronoloom.session import checkpoint_root, stage
from chronoloom.sources import description as ds, sinks, tables


def scratch(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {TYPES_SQL} SELECT node, ts, {sql_r6('CAST(value AS FLOAT)', 3)} AS value FROM types")
def wide_csv(spark, sf_dir):
    """SRC4: one column per series, written and read back as long rows."""
    path = scratch(spark, "wide")
    wide = type_panel(spark, sf_dir).groupBy(F.col("ts").alias("date")).pivot("node", TYPES).agg(F.first("value"))
    sinks.write_csv(wide, path)
    return tables.read_wide_csv(spark, path, TIME_FORMAT).select("node", "ts", r6("value", 3).alias("value"))


def encoded(line: Column, encoding: Column) -> Column:
    """The bytes of a line in an encoding, as the text writer puts them down."""
    @F.pandas_udf("binary")
    def run(lines: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([t.encode(e) for t, e in zip(lines, encodings)], dtype=object)

    return run(line, encoding).cast("string")


@query(f"""SELECT CASE WHEN s_suppkey % 3 = 1 THEN 'gbk' WHEN s_suppkey % 3 = 2 THEN 'latin-1' ELSE 'utf-8' END AS encoding,
 TIMESTAMP '2024-01-01' + to_hours(s_suppkey) AS ts, CASE k WHEN 0 THEN 'water_temp' WHEN 1 THEN 'Größe' ELSE 'note' END AS indicator,
 CASE k WHEN 0 THEN CAST(s_nationkey AS VARCHAR) WHEN 1 THEN s_name ELSE CASE WHEN s_suppkey % 3 = 0 THEN '水温é' WHEN s_suppkey % 3 = 1 THEN '水温' ELSE 'é' END END AS raw
FROM supplier CROSS JOIN (SELECT unnest(range(3)) AS k)""")
def mixed_encodings(spark, sf_dir):
    """SRC5: files in three encodings, told apart only by what stands in their last fields."""
    path = scratch(spark, "sensors")
    k = F.col("s_suppkey") % 3
    kind = lambda gbk, latin, utf: F.when(k == 1, gbk).when(k == 2, latin).otherwise(utf)
    rows = table(spark, sf_dir, "supplier").select(
        kind("gbk", "latin-1", "utf-8").alias("encoding"), F.col("s_suppkey").alias("no"), F.concat_ws(
            ",", F.date_format(F.timestamp_add("HOUR", F.col("s_suppkey"), F.lit("2024-01-01").cast("timestamp_ntz")), TIME_FORMAT),
            F.col("s_nationkey").cast("string"), "s_name", kind(F.lit("水温"), F.lit("é"), F.lit("水温é"))).alias("line"))
    # plain names in front, so that the start of a file tells nothing
    heads = rows.select("encoding").distinct().withColumn("no", F.lit(-1).cast("long")).withColumn(
        "line", F.lit("DATE,temp,size,note"))
    lines = rows.unionByName(heads).repartition("encoding").sortWithinPartitions("encoding", "no")
    lines.select(encoded(F.col("line"), F.col("encoding")).alias("value"), "encoding").write.partitionBy("encoding").text(path)
    back = tables.read_sensor_csv(spark, path, {"temp": "water_temp", "size": "Größe"})
    return back.select("encoding", "ts", "indicator", "raw")


@query(f"WITH {PANEL_SQL} SELECT ts, CAST(node AS INTEGER) AS node, {sql_r6('CAST(value AS FLOAT)', 3)} AS value FROM panel WHERE node < 3 AND node >= 0")
def inference_csv(spark, sf_dir):
    """SRC7, SNK7, SRT1: a headerless file of stamps and series in order of time, read as input of a model."""
    path = scratch(spark, "inference")
    panel = user_panel(spark, sf_dir).where("node >= 0 AND node < 3")
    nodes = [r.node for r in panel.select("node").distinct().orderBy("node").collect()]
    sinks.write_future(panel.select("ts", "node", "value"), path, nodes)
    back = tables.read_inference(spark, path, len(nodes))
    names = F.array(*[F.lit(n).cast("int") for n in nodes])
    return back.select("ts", F.get(names, F.col("node")).alias("node"), r6("value", 3).alias("value"))


@query(f"""WITH ids AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier),
raw AS (SELECT l_suppkey AS a, 1 + (l_partkey % (SELECT count(*) FROM supplier)) AS b, max(l_extendedprice) AS distance FROM lineitem GROUP BY ALL),
e AS (SELECT x.position AS src, y.position AS dst, distance, (a, b) AS line FROM raw JOIN ids x ON x.id = a JOIN ids y ON y.id = b)
SELECT src, dst, {sql_r6('arg_max(distance, line)', 2)} AS distance FROM (SELECT * FROM e UNION ALL SELECT dst, src, distance, line FROM e) GROUP BY src, dst""")
def edge_files(spark, sf_dir):
    """SRC10: an edge list with header and broken rows, and an id list; the later line wins."""
    edges, ids = scratch(spark, "edges"), scratch(spark, "ids")
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.count()
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (1 + F.col("l_partkey") % n).alias("b"), "l_extendedprice")
    many = items.count()
    rows = spread_if_many(items, many, "a", "b").groupBy("a", "b").agg(F.max("l_extendedprice").alias("d"))
    lines = rows.select("a", "b", F.concat_ws(",", "a", "b", F.format_string("%.2f", "d")).alias("value")).unionByName(
        suppliers.select(F.lit(0).cast("long").alias("a"), F.col("s_suppkey").alias("b"), F.lit("broken,row").alias("value")))
    lines.repartitionByRange(partitions_for(lines, many), "a", "b").sortWithinPartitions("a", "b").select("value").write.text(edges)
    suppliers.repartitionByRange("s_suppkey").sortWithinPartitions("s_suppkey").select(F.col("s_suppkey").cast("string")).write.text(ids)
    out = gr.symmetric_edges(gr.map_ids(tables.read_edges(spark, edges), tables.read_node_ids(spark, ids)))
    return out.select("src", "dst", r6("distance", 2).alias("distance"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def meta_csv(spark, sf_dir):
    """SRC11: a table of stations with its own types."""
    path = scratch(spark, "meta")
    table(spark, sf_dir, "nation").write.option("header", True).csv(path)
    return tables.read_meta(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query(f"""WITH {FORECAST_SQL}, c AS (SELECT split, step, CASE WHEN target IS NOT NULL THEN prediction END AS p, CASE WHEN prediction IS NOT NULL THEN target END AS t FROM forecast)
SELECT 'naive' AS model, CASE split WHEN 'valid' THEN 'val' ELSE split END AS split, CAST(step AS VARCHAR) AS feature, CAST(count(*) AS DOUBLE) AS samples_count,
 {sql_r6('sqrt(avg((t - p) * (t - p)))', 4)} AS rmse_val FROM c GROUP BY split, step""")
def metric_tables(spark, sf_dir):
    """SRC12, PR6: evaluation files of a model by split, found below a folder and read as one table."""
    root = scratch(spark, "models")
    split = F.when(F.col("split") == "valid", "val").otherwise(F.col("split"))
    rows = stage(ev.feature_table(user_forecast(spark, sf_dir), "step", ["split"]).withColumn("split", split))
    for name in ("train", "val", "test"):  # the three files that a model has
        mine = rows.where(F.col("split") == name).select(*[c.split()[0] for c in tables.METRIC_COLUMNS.split(", ")])
        mine.coalesce(1).write.option("header", True).csv(f"{root}/naive/evaluation/{name}_metrics_unnorm.csv")
    return tables.read_metric_tables(spark, root).where(~F.col("feature").isin("avg", "all")).select(
        "model", "split", "feature", "samples_count", r6("rmse_val", 4).alias("rmse_val"))


@query(f"""WITH {PANEL_SQL} SELECT 'users' AS name, [any_value(steps), count(DISTINCT node), 1]::BIGINT[] AS shape, any_value(steps) AS num_time_steps,
 count(DISTINCT node) AS num_nodes, 360.0::DOUBLE AS minutes, 8 AS input_len FROM panel CROSS JOIN panel_lim""")
def description_round_trip(spark, sf_dir):
    """SRC2, SRC3, SNK2, DS2: a description written beside its dataset and read back."""
    folder = scratch(spark, "datasets")
    made = ds.describe(user_panel(spark, sf_dir), "users", "events", ["value"], 4, settings={"INPUT_LEN": IN_LEN, "OUTPUT_LEN": OUT_LEN})
    ds.write_description(made, f"{folder}/users/desc.json")
    back = ds.read_description(spark, [f"{folder}/none", folder], "users")
    given = ds.read_settings(spark, [folder], "users")
    return back.select("name", "shape", "num_time_steps", "num_nodes", F.col("frequency (minutes)").alias("minutes"), F.lit(given.INPUT_LEN).alias("input_len"))


@query(f"WITH {FORECAST_SQL} SELECT split, count(*) AS n, {sql_r6('sum(prediction)', 3)} AS total FROM forecast GROUP BY split")
def forecast_files(spark, sf_dir):
    """SNK5: the forecast table by split."""
    path = scratch(spark, "forecast")
    sinks.write_forecast(user_forecast(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("prediction"), 3).alias("total"))


@query(f"""WITH {FORECAST_SQL} SELECT split, {sql_r6(f'sum(CASE WHEN {M} THEN coalesce(abs(prediction - target), 0) END) / count(*) FILTER (WHERE {M})')} AS mae FROM forecast GROUP BY split""")
def metric_record(spark, sf_dir):
    """SNK6: a nested record per split; the overall error is read back out of it."""
    path = scratch(spark, "metrics")
    sinks.write_metrics(mt.horizon_metrics(user_forecast(spark, sf_dir), [1], ["MAE", "RMSE"], ["split"], 0.0), path)
    back = spark.read.schema("split string, scopes map<string,string>").json(path)
    return back.select("split", r6(F.get_json_object(F.col("scopes")["overall"], "$.MAE").cast("double")).alias("mae"))


@query(f"""WITH {FORECAST_SQL} SELECT count(*) // 2 AS n, {', '.join(f"{sql_r6(f'avg(target) FILTER (WHERE step = {k})')} AS truth_{k}, {sql_r6(f'avg(prediction) FILTER (WHERE step = {k})')} AS pred_{k}" for k in (1, 2))}
 FROM forecast WHERE step <= 2""")
def result_files(spark, sf_dir):
    """SNK8: truth and prediction of every feature side by side; the horizon step plays the feature."""
    path = scratch(spark, "results")
    rows = user_forecast(spark, sf_dir).where("step <= 2").withColumn("feature", F.concat(F.lit("f"), F.col("step")))
    sinks.write_results(rows, path, "feature", ["f1", "f2"], keys=("split", "sample_id", "node"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(path)
    mean = lambda c: r6(F.avg(F.col(c).cast("double")))
    return back.agg(F.count(F.lit(1)).alias("n"), mean("f1").alias("truth_1"), mean("f1_pred").alias("pred_1"),
                    mean("f2").alias("truth_2"), mean("f2_pred").alias("pred_2"))


@query(f"""SELECT l_returnflag AS "column", {sql_r6('quantile_cont(l_extendedprice, 0.01)', 5)} AS q01, {sql_r6('quantile_cont(l_extendedprice, 0.99)', 5)} AS q99, false AS log1p
FROM lineitem GROUP BY l_returnflag""")
def transform_record(spark, sf_dir):
    """SNK4: the steps of a fitted transform as nested records, and flat again."""
    path = scratch(spark, "transform")
    long = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("column"), F.col("l_extendedprice").alias("value"))
    sinks.write_transform_meta(sc.fit_chain(long, ["column"], "value", (), standardize=True), path)
    back = sinks.read_transform_meta(spark, path)
    return back.select("column", r6("q01", 5).alias("q01"), r6("q99", 5).alias("q99"), "log1p")


@query("""SELECT 'nation' AS name, count(*) AS num_rows, 3 AS num_columns, 'n_nationkey,n_regionkey' AS numeric_columns FROM nation
UNION ALL SELECT 'supplier', count(*), 4, 's_suppkey,s_nationkey,s_acctbal' FROM supplier UNION ALL SELECT 'none', NULL, NULL, NULL""")
def dataset_report(spark, sf_dir):
    """PR2, SNK9: a row per dataset, one of which is not there."""
    path = scratch(spark, "report")
    sources = {n: f"{sf_dir}/{n}.parquet" for n in ("nation", "supplier", "none")}
    sinks.write_dataset_report(pf.dataset_report(spark, sources, spark.read.parquet), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("name", F.col("num_rows").cast("long").alias("num_rows"), F.col("num_columns").cast("int").alias("num_columns"), "numeric_columns")


@query("SELECT l_suppkey AS src, l_partkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL")
def graph_files(spark, sf_dir):
    """SNK10: an edge table that is built once and found the second time."""
    path = scratch(spark, "graph")
    build = lambda: table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))

    def again() -> DataFrame:
        raise RuntimeError("it is there already")

    sinks.write_graph(spark, path, build)
    return sinks.write_graph(spark, path, again)


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_linenumber IN (1, 3)")
def channel_subset(spark, sf_dir):
    """PRJ1, PRJ2, PRJ3: lines of an order play the channels, columns the features."""
    rows = pn.select_channels(table(spark, sf_dir, "lineitem"), [1, 3], "l_linenumber")
    return pn.select_features(rows, ["l_orderkey", "l_linenumber"], ["l_tax"])


@query(f"WITH {PANEL_SQL} SELECT node, t_idx, {sql_r6('value')} AS value FROM panel WHERE node IN (1, 2, 5) AND t_idx >= 10 AND t_idx < 30")
def series_slice(spark, sf_dir):
    """PRJ6."""
    axis = user_axis(spark, sf_dir)
    out = pn.slice_series(user_panel(spark, sf_dir, axis), [1, 2, 5], 10, 30, axis.length)
    return out.select("node", "t_idx", r6("value").alias("value"))


@query(f"""WITH {SAMPLES_SQL}, s AS (SELECT split, node, pos AS sample_id FROM rows_in WHERE pos + {IN_LEN + OUT_LEN} <= len)
SELECT split, node, sample_id, CAST({OUT_LEN} AS INTEGER) AS steps, 0 AS known FROM s""")
def hidden_future(spark, sf_dir):
    """PRJ7: outside training a model sees no target."""
    out = pn.hide_future(user_samples(spark, sf_dir))
    return out.select("split", "node", "sample_id", F.size("target").alias("steps"), F.size(F.array_compact("target")).alias("known"))


RATIO_SQL = "CASE WHEN l_discount = 0 THEN CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END ELSE l_tax / l_discount END"


@query(f"""SELECT l_orderkey, l_linenumber, {sql_r6(f'CASE WHEN isfinite({RATIO_SQL}) THEN {RATIO_SQL} ELSE 0 END')} AS zeroed,
 {sql_r6(f'CASE WHEN isfinite({RATIO_SQL}) THEN {RATIO_SQL} END')} AS missing FROM lineitem""")
def finite_values(spark, sf_dir):
    """PRJ14, PRJ16: NaN and infinities to zero, or to missing."""
    nan = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    v = F.when(F.col("l_discount") == 0, nan).otherwise(F.col("l_tax") / F.nullif(F.col("l_discount"), F.lit(0.0)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return rows.select("l_orderkey", "l_linenumber", r6(scalars.finite_or_zero("v")).alias("zeroed"), r6(scalars.finite_or_null("v")).alias("missing"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def first_channels(spark, sf_dir):
    """PRJ18: as many channels as a model takes."""
    return pn.match_width(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax", "l_discount"], 2)


LONG_OUT = 40


@query(f"""WITH {PANEL_SQL}, {bounds_sql(IN_LEN, LONG_OUT)} SELECT split, lo, hi, greatest(hi - lo - {IN_LEN + LONG_OUT} + 1, 0) AS samples FROM bounds""")
def short_splits(spark, sf_dir):
    """SPL4: splits shorter than one sample borrow from their neighbours."""
    axis = user_axis(spark, sf_dir)
    return sp.bounds_table(spark, sp.split_bounds(axis.length, RATIO, IN_LEN, LONG_OUT), IN_LEN, LONG_OUT)


@query(f"""WITH {SAMPLES_SQL}, s AS (SELECT split, node, pos AS sample_id FROM rows_in WHERE pos + {IN_LEN + OUT_LEN} <= len AND split = 'test')
SELECT s.sample_id, s.node, {sql_r6('avg(r.value)')} AS mean, count(r.value) AS present FROM s JOIN rows_in r ON r.split = s.split AND r.node = s.node
 AND r.pos BETWEEN s.sample_id AND s.sample_id + {IN_LEN - 1} GROUP BY ALL""")
def flat_windows(spark, sf_dir):
    """WIN6: univariate windows."""
    from chronoloom.functions.arrays import array_mean

    out = wn.flatten_windows(user_samples(spark, sf_dir).where("split = 'test'"))
    return out.select("sample_id", "node", r6(array_mean("window")).alias("mean"), F.size(F.array_compact("window")).cast("long").alias("present"))


@query(f"""WITH long AS (SELECT 'first' AS dataset, event_id AS "row", value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'second', event_id, value * 2 FROM events WHERE event_id % 2 = 1),
q AS (SELECT dataset, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM long GROUP BY dataset)
SELECT dataset, "row", 'value' AS "column", {sql_r6('least(greatest(value, a), b)', 5)} AS value FROM long JOIN q USING (dataset)""")
def chained_datasets(spark, sf_dir):
    """SCL13: two inputs as one long table with a transform each."""
    events = table(spark, sf_dir, "events")
    parts = {"first": events.where("event_id % 2 = 0"), "second": events.where("event_id % 2 = 1").withColumn("value", F.col("value") * 2)}
    long = sc.chain_datasets(parts, ["value", "absent"], row="event_id")
    out = sc.winsorize(long, ["dataset", "column"], "value")
    return out.select("dataset", "row", "column", r6("value", 5).alias("value"))


def bias(prediction: str = "prediction", target: str = "target") -> Column:
    return F.avg(F.col(prediction) - F.col(target))


def close(limit: float, null_val: float | None = None) -> Column:
    hit = F.abs(F.col("prediction") - F.col("target")) < limit
    return F.avg(F.when(mt.valid(F.col("target"), null_val, True), F.coalesce(hit, F.lit(False)).cast("double")))


@query(f"""WITH {FORECAST_SQL} SELECT split, {sql_r6('avg(prediction - target)')} AS bias,
 {sql_r6(f'avg(CASE WHEN {M} THEN CASE WHEN abs(prediction - target) < 10 THEN 1.0 ELSE 0.0 END END)')} AS close FROM forecast GROUP BY split""")
def own_metrics(spark, sf_dir):
    """MET11: metrics of the user, one of which takes the value that marks missing data."""
    out = mt.evaluate(user_forecast(spark, sf_dir), [bias, mt.named_metric(close, limit=10.0)], ["split"], null_val=0.0)
    return out.select("split", r6("bias").alias("bias"), r6("close").alias("close"))


@query(f"""WITH {FORECAST_SQL}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM panel), c AS (
 SELECT split, step, CASE WHEN target IS NOT NULL THEN (prediction - m) / d END AS p, CASE WHEN prediction IS NOT NULL THEN (target - m) / d END AS t FROM forecast CROSS JOIN s)
SELECT split, CAST(step AS VARCHAR) AS feature, {sql_r6('sqrt(avg((t - p) * (t - p)))')} AS rmse_val,
 {sql_r6('count(*) FILTER (WHERE abs(p - t) / (abs(t) + 1e-8) < 0.05) * 1.0 / count(*)')} AS per_less_5 FROM c GROUP BY split, step""")
def normalised_evaluation(spark, sf_dir):
    """MET16: the feature table on standardised values."""
    stats = user_panel(spark, sf_dir).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d")).first()
    scaled = lambda c: (F.col(c) - F.lit(stats.m)) / F.lit(stats.d)
    rows = user_forecast(spark, sf_dir).withColumns({c: scaled(c) for c in ("prediction", "target")})
    out = ev.feature_table(rows, "step", ["split"]).where(~F.col("feature").isin("avg", "all"))
    return out.select("split", "feature", r6("rmse_val").alias("rmse_val"), r6("per_less_5").alias("per_less_5"))


def across_nodes(x: np.ndarray) -> np.ndarray:
    """A model that looks across nodes: their mean at the last step, for all."""
    return np.full((len(x), OUT_LEN), x[:, -1].mean())


@query(f"""WITH {FILLED_SQL}, {bounds_sql()},
rows_in AS (SELECT split, node, t_idx - lo AS pos, hi - lo AS len, value FROM filled JOIN bounds ON t_idx >= lo AND t_idx < hi)
SELECT split, pos - {IN_LEN - 1} AS sample_id, node, {sql_r6('avg(value) OVER (PARTITION BY split, pos)')} AS prediction FROM rows_in
WHERE pos >= {IN_LEN - 1} AND pos - {IN_LEN - 1} + {IN_LEN + OUT_LEN} <= len AND split = 'test'""")
def joint_scoring(spark, sf_dir):
    """SCO1 for models that see all nodes of a sample at once."""
    samples = _filled_samples(spark, sf_dir).where("split = 'test'")
    out = fc.score_jointly(samples, across_nodes, ["split", "sample_id"], OUT_LEN)
    return out.select("split", "sample_id", "node", r6(F.element_at("prediction", 1)).alias("prediction"))


@query(f"""WITH {FILLED_SQL}, {bounds_sql()},
rows_in AS (SELECT split, node, t_idx - lo AS pos, hi - lo AS len, value FROM filled JOIN bounds ON t_idx >= lo AND t_idx < hi),
m AS (SELECT *, avg(value) OVER (PARTITION BY split, node ORDER BY pos ROWS BETWEEN {IN_LEN} PRECEDING AND 1 PRECEDING) AS mean FROM rows_in),
e AS (SELECT m.split, m.node, m.pos, h.h, abs(m.mean - t.value) AS e FROM m CROSS JOIN (SELECT unnest(range({OUT_LEN})) AS h) h
 JOIN rows_in t ON t.split = m.split AND t.node = m.node AND t.pos = m.pos + h.h WHERE m.pos >= {IN_LEN} AND m.pos + {OUT_LEN} <= m.len)
SELECT split, CASE WHEN grouping(h) = 1 THEN 'overall' ELSE 'horizon_' || (h + 1) END AS scope, 'MAE' AS metric, {sql_r6('avg(e)')} AS value
FROM e WHERE true GROUP BY GROUPING SETS ((split), (split, h)) HAVING grouping(h) = 1 OR h IN (0, 3)""")
def split_evaluation(spark, sf_dir):
    """MET17: a model scored on all samples of the three splits in one job."""
    axis = user_axis(spark, sf_dir)
    _, found = fg.evaluate_splits(_filled(spark, sf_dir, axis), window_mean, axis.length, RATIO, IN_LEN, OUT_LEN, ["MAE"], [1, 4])
    return found.select("split", "scope", "metric", r6("value").alias("value"))


def _stations(strategy: str) -> str:
    return f"""wide AS (SELECT station, t_idx, row_number() OVER (PARTITION BY station ORDER BY t_idx) - 1 AS pos,
 {', '.join(f"max(value) FILTER (WHERE indicator = '{t}') AS {t}" for t in TYPES)} FROM o GROUP BY station, t_idx),
{knn_sql('wide', 'station', 'pos', TYPES)}"""


@query(f"""WITH {stations_sql("conservative")}, {_stations("conservative")}
SELECT station, t_idx, CAST(pos AS BIGINT) AS pos, indicator, {sql_r6("round_even(value, 9)", 9)} AS value
FROM imputed UNPIVOT INCLUDE NULLS (value FOR indicator IN ({', '.join(TYPES)}))""")
def clean_conservative(spark, sf_dir):
    """PIPE2 with the longest gaps and widest limits."""
    out = cl.clean_stations(sensor_panel(spark, sf_dir), sensor_config(spark), "conservative")
    return out.select("station", "t_idx", "pos", "indicator", r6("value", 9).alias("value"))


@query(f"""WITH RECURSIVE {stations_sql("segmented")}, {fill_sql("o", "pos", False)}
SELECT 'segmented' AS strategy, station, indicator, count(*) AS n, count(value) AS present, {sql_r6("sum(round(CAST(value AS DECIMAL(18, 9)), 4))", 4)} AS total
FROM done GROUP BY ALL""")
def batch_segmented(spark, sf_dir):
    """PIPE4's rows: every strategy on every station in one job; here what interpolation made."""
    rows, _ = cl.batch_clean(sensor_panel(spark, sf_dir), sensor_config(spark))
    mine = rows.where("strategy = 'segmented'")
    return mine.groupBy("strategy", "station", "indicator").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("present"), r6(F.sum(F.round("value", 4)), 4).alias("total"))
