import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import evaluate as ev, metrics as mt, models, profile as pf

NAN = float("nan")


def rows(spark, p, t, group=None):
    data = [(0 if group is None else group[i], i + 1, 0, 0, float(p[i]), None if t[i] is None else float(t[i])) for i in range(len(p))]
    return spark.createDataFrame(data, "sample_id int, step int, node int, channel int, prediction double, target double")


@pytest.mark.parametrize("metric, p, t, null_val, expected", [
    ("MAE", [1, 2, 3], [1, 2, 3], NAN, 0.0),
    ("MAE", [1, 2, 3], [1, NAN, 3], NAN, 0.0),
    ("MAE", [1, 2, 3], [1, NAN, 4], NAN, 0.5),
    ("MAE", [1, 2, 3], [1, -1, 4], -1.0, 0.5),
    ("MAE", [1, 2, 3], [NAN, NAN, NAN], NAN, 0.0),
    ("MSE", [1, 3, 3, 5], [1, 2, 3, 4], NAN, 0.5),
    ("MSE", [2, 3, 3, 5], [1, 2, NAN, 4], NAN, 1.0),
    ("MSE", [2, 3, 3, 5], [1, 2, -1, 4], -1.0, 1.0),
    ("MSE", [2, 3], [NAN, NAN], NAN, 0.0),
    ("MAPE", [2, 3, 3], [1, 3, 2], NAN, 0.5),
    ("MAPE", [2, 3, 4], [0, 3, 2], NAN, 0.5),
    ("MAPE", [2, 3, 4], [NAN, 3, 2], NAN, 0.5),
    ("MAPE", [2, 3, 4], [-1, 3, 2], -1.0, 0.5),
    ("MAPE", [2, 3, 4], [0, 0, 0], NAN, 0.0),
])
def test_hand_cases(spark, metric, p, t, null_val, expected):
    got = mt.evaluate(rows(spark, p, t), [metric], null_val=null_val).first()[0]
    assert got == pytest.approx(expected, abs=1e-9)


def brute(p, t, null_val):
    """All metrics over ``[sample, step]`` arrays, spelled out."""
    valid = ~np.isnan(t) & (np.abs(np.nan_to_num(t) - null_val) > 5e-5)
    strict = ~np.isnan(t) & (np.abs(np.nan_to_num(t) - null_val) > 5e-5 + 1e-5 * abs(null_val))
    nonzero = strict & (np.abs(np.nan_to_num(t)) > 5e-5)
    e = np.abs(p - t)
    zp, zt = np.where(strict, p, 0), np.where(strict, np.nan_to_num(t), 0)
    he = np.abs(zp - zt)
    out = {
        "MAE": e[valid].mean(), "MSE": (e[strict] ** 2).mean(), "RMSE": math.sqrt((e[strict] ** 2).mean()),
        "MAPE": (e[nonzero] / np.abs(t[nonzero])).mean(),
        "SMAPE": (e[nonzero] / ((np.abs(p) + np.abs(t))[nonzero] / 2)).mean(),
        "Huber": np.where(he <= 1, 0.5 * he**2, he - 0.5).mean(),
        "WAPE": (np.abs(zp - zt).sum(1) / (np.abs(zt).sum(1) + 5e-5)).mean(),
    }
    rp, rt = np.where(valid, p, 0), np.where(valid, np.nan_to_num(t), 0)
    out["R2"] = (1 - ((rt - rp) ** 2).sum(1) / (((rt - rt.mean(1, keepdims=True)) ** 2).sum(1) + 5e-5)).mean()
    c, w = [], []
    for a, b, m in zip(p, t, valid):
        w.append(m.sum())
        c.append(0.0 if np.isnan(b).any() or b.std() == 0 or a.std() == 0 else np.corrcoef(a, b)[0, 1])
    out["CORR"] = np.dot(c, w) / np.sum(w)
    return out


def test_all_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    p, t = rng.normal(3, 2, (40, 6)), rng.normal(3, 2, (40, 6))
    t[rng.random(t.shape) < 0.1] = np.nan
    t[rng.random(t.shape) < 0.1] = 0.0
    t[3] = np.nan
    t[4] = 2.5
    data = [(s, k + 1, 0, 0, float(p[s, k]), float(t[s, k])) for s in range(40) for k in range(6)]
    df = spark.createDataFrame(data, "sample_id int, step int, node int, channel int, prediction double, target double")
    got = mt.evaluate(df, null_val=0.0).first().asDict()
    for name, value in brute(p, t, 0.0).items():
        assert got[name] == pytest.approx(value, rel=1e-9), name


def test_wape_of_two_rows(spark):
    p, t = [1, 2, 3, 4, 5, 6], [2, 2, 4, 4, 6, 5]
    df = rows(spark, p, t, [0, 0, 0, 1, 1, 1])
    assert mt.evaluate(df, ["WAPE"]).first()[0] == pytest.approx((2 / 8 + 2 / 15) / 2, abs=1e-4)


def test_horizons_group_across_nodes(spark):
    rng = np.random.default_rng(2)
    data = [(s, k, n, 0, float(rng.normal(5)), float(rng.normal(5))) for s in range(5) for k in (1, 2) for n in range(4)]
    df = spark.createDataFrame(data, "sample_id int, step int, node int, channel int, prediction double, target double")
    got = {(r.scope, r.metric): r.value for r in mt.horizon_metrics(df, [2], ["WAPE", "MASE"]).collect()}
    assert set(got) == {("overall", "WAPE"), ("horizon_2", "WAPE")}
    a = np.array([[(d[4], d[5]) for d in data if d[0] == s and d[1] == 2] for s in range(5)])
    expected = (np.abs(a[..., 0] - a[..., 1]).sum(1) / (np.abs(a[..., 1]).sum(1) + 5e-5)).mean()
    assert got["horizon_2", "WAPE"] == pytest.approx(expected)


def test_user_metric_gets_null_value_only_if_it_asks(spark):
    def bias():
        return F.avg(F.col("prediction") - F.col("target"))

    def seen(null_val):
        return F.lit(null_val)

    pinball = mt.named_metric(mt.masked_huber, "half", delta=0.5)
    row = mt.evaluate(rows(spark, [1, 2], [0, 0]), [bias, seen, pinball], null_val=7.0).first().asDict()
    assert row["bias"] == 1.5 and row["seen"] == 7.0 and row["half"] == pytest.approx((0.375 + 0.875) / 2)
    with pytest.raises(ValueError):
        mt.evaluate(rows(spark, [1], [1]), ["nope"])


def test_huber_reductions(spark):
    df = rows(spark, [1, 5], [1.5, 1])
    assert df.agg(mt.masked_huber(reduction="sum")).first()[0] == pytest.approx(0.125 + 3.5)
    each = [r[0] for r in df.orderBy("step").select(mt.masked_huber(reduction="none")).collect()]
    assert each == pytest.approx([0.125, 3.5])


def test_meters(spark):
    df = spark.createDataFrame([("a", 2.0, 1), ("a", 4.0, 3)], "g string, value double, n int")
    assert mt.meter(df, ["g"]).first().value == pytest.approx(3.5)
    assert mt.meter(df, ["g"], squared=True).first().value == pytest.approx(math.sqrt((4 + 48) / 4))


def test_best_model_direction(spark):
    df = spark.createDataFrame(
        [("MAE", 1, 3.0), ("MAE", 2, 1.0), ("MAE", 3, NAN), ("accuracy", 1, 0.2), ("accuracy", 2, 0.9)],
        "metric string, epoch int, value double")
    got = {r.metric: r.epoch for r in mt.best_model(df, [], "metric", "value", "epoch").collect()}
    assert got == {"MAE": 2, "accuracy": 2}


def test_feature_table(spark):
    rng = np.random.default_rng(3)
    t = rng.uniform(-5, 5, (50, 2))
    p = t + rng.normal(0, 0.4, t.shape)
    t[:, 1] = 4.0
    data = [(i, f"f{j}", float(p[i, j]), float(t[i, j])) for i in range(50) for j in range(2)]
    df = spark.createDataFrame(data, "sample_id int, feature string, prediction double, target double")
    got = {r.feature: r for r in ev.feature_table(df, "feature").collect()}
    assert set(got) == {"f0", "f1", "avg", "all"}
    rel = np.abs(p - t) / (np.abs(t) + 1e-8)
    assert got["f0"].count_less_5 == (rel[:, 0] < 0.05).sum()
    assert got["avg"].count_less_10 == (rel < 0.10).sum()
    assert got["f0"].nse_val == pytest.approx(1 - ((p - t)[:, 0] ** 2).sum() / ((t[:, 0] - t[:, 0].mean()) ** 2).sum())
    assert got["f1"].nse_val is None and got["f1"].nrmse_val is None
    assert got["all"].rmse_val == pytest.approx(math.sqrt(((p - t) ** 2).mean()))
    assert got["all"].per_less_5 == got["avg"].per_less_5
    signed = {r.feature: r for r in ev.feature_table(df, "feature", compat=True).collect()}
    assert signed["f0"].count_less_5 == (np.abs(p - t) / (t + 1e-8) < 0.05)[:, 0].sum()


def test_result_columns(spark):
    df = spark.createDataFrame(
        [(0, 1, "a", 1.0, 2.0), (0, 1, "b", 3.0, 4.0)], "sample_id int, step int, feature string, prediction double, target double")
    out = ev.result_columns(df, ["sample_id", "step"], "feature", ["a", "b"])
    assert out.columns == ["sample_id", "step", "a", "a_pred", "b", "b_pred"]
    assert tuple(out.first()) == (0, 1, 2.0, 1.0, 4.0, 3.0)


def test_diagnosis(spark):
    df = spark.createDataFrame(
        [("m", "val", -0.1, 0.9, 0.1), ("m", "val", 0.9, 0.1, 0.2), ("m", "test", 0.9, 0.1, 0.9)],
        "model string, split string, r2_val double, nrmse_val double, per_less_5 double")
    got = {r.split: r.issues for r in pf.diagnose(df).collect()}
    assert len(got["val"]) == 4 and got["val"][0].startswith("1 feature(s) r2<0")
    assert got["test"] == []
    assert pf.diagnose(df.select("model", "split")).first().issues == ["metrics file empty or unreadable"]


def test_feature_table_counts_nan_as_missing(spark):
    from chronoloom.operators.evaluate import feature_table

    nan, inf = float("nan"), float("inf")
    rows = [("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", nan, 4.0), ("a", 4.0, nan), ("a", inf, 4.0)]
    got = {r["feature"]: r for r in feature_table(spark.createDataFrame(rows, "f string, prediction double, target double"), "f").collect()}
    for name in ("a", "avg", "all"):
        assert got[name]["rmse_val"] == 0.5 ** 0.5 and got[name]["nse_val"] == 0.5 and got[name]["samples_count"] == 5


def test_description_counts_nodes_that_begin_later(spark):
    from chronoloom.sources.description import describe

    series = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "node string, t_idx long")
    assert describe(series, "x", "d", ["v"], 24).first()["shape"] == [2, 2, 1]


@pytest.mark.parametrize("null_val", [None, 0.0])
def test_samples_give_the_metrics_of_their_elements(spark, null_val):
    """Folding arrays and grouping elements agree, with missing, infinite, masked and constant values; no exchange by sample."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(60):
        p, t = rng.normal(0, 2, 5), rng.normal(0, 2, 5)
        p[rng.random(5) < 0.1] = np.nan
        t[rng.random(5) < 0.1] = rng.choice([np.nan, np.inf, 0.0])
        if k % 10 == 0:
            p, t = rng.normal(0, 1, 5), np.full(5, 0.1)
        if k % 3 == 0:
            p, t = np.nan_to_num(p), np.nan_to_num(t, posinf=1.0)
        clean = lambda v: [None if np.isnan(x) and k % 2 else float(x) for x in v]  # noqa: B023, E731
        rows.append((f"s{k % 3}", k, 0, clean(p), clean(t)))
    samples = spark.createDataFrame(rows, "split string, sample_id int, node int, prediction array<double>, target array<double>")
    folded = mt.evaluate_samples(samples, by=["split"], null_val=null_val)
    long = models.forecast_rows(samples, ["split", "sample_id", "node"])
    want = {r.split: r for r in mt.evaluate(long, by=["split"], null_val=null_val).collect()}
    for r in folded.collect():
        for m in mt.METRICS:
            assert r[m] == pytest.approx(want[r.split][m], rel=1e-9, abs=1e-12), m
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(split" in plan and "sample_id" not in plan.split("hashpartitioning(")[1].split(")")[0]
    with pytest.raises(ValueError):
        mt.evaluate_samples(samples, ["nope"])
