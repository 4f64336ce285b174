import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import arrays, calendar as cal
from chronoloom.operators import forecast as fc, metrics as mt, models, split as sp, windows as wn
from chronoloom.plans import forecasting as fg


def waves(spark, n=240, nodes=3):
    angle = F.col("id") * 2 * np.pi / 12
    return spark.range(n).select(
        F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"), F.col("id").alias("t_idx"),
        cal.from_micros(F.col("id") * 3_600_000_000).alias("ts"), angle.alias("_a")).select(
        "node", "t_idx", "ts", (F.sin("_a") * (F.col("node") + 1) + 0.3 * F.cos(F.col("_a") * 2) + F.col("node")).alias("value"))


def samples_of(df, in_len=24, out_len=6):
    return wn.sliding_windows(df, ["node"], "t_idx", ["value"], in_len, out_len)


def test_linear_spectrum_learns_a_periodic_series(spark):
    samples = samples_of(waves(spark))
    model = fc.fit_frequency_linear(samples, 24, 6, ridge=1e-6)
    out = models.forecast_rows(fc.score(samples, model, ["node", "sample_id"], 6), ["node", "sample_id"])
    assert mt.evaluate(out, ["MAE"]).first()[0] < 1e-2


def test_moments_equal_numpy(spark):
    samples = samples_of(waves(spark, 60, 2), 8, 4).repartition(5)
    model = fc.fit_frequency_linear(samples, 8, 4, ridge=0.5)
    rows = samples.collect()
    z, c, s = fc.normalise(np.array([r.inputs for r in rows]))
    a, b = fc.spectrum(z), fc.spectrum((np.array([r.target for r in rows]) - c) / s)
    np.testing.assert_allclose(model.weights, np.linalg.solve(a.T @ a + 0.5 * np.eye(10), a.T @ b), atol=1e-8)


def test_missing_windows_are_not_trained_on(spark):
    df = waves(spark, 60, 1).withColumn("value", F.when(F.col("t_idx") != 30, F.col("value")))
    kept = samples_of(df, 8, 4).where("not exists(inputs, x -> x is null) and not exists(target, x -> x is null)")
    a = fc.fit_frequency_linear(samples_of(df, 8, 4), 8, 4)
    b = fc.fit_frequency_linear(kept, 8, 4)
    np.testing.assert_allclose(a.weights, b.weights, atol=1e-9)


def test_models_per_dataset(spark):
    samples = samples_of(waves(spark, 80, 2), 8, 4).withColumn("dataset", F.concat(F.lit("d"), F.col("node")))
    fitted = fc.fit_per_dataset(samples, "dataset", 8, 4)
    table = {r.dataset: fc.frequency_model(r.weights, 8, 4) for r in fitted.collect()}
    assert set(table) == {"d0", "d1"}
    alone = fc.fit_frequency_linear(samples.where("node = 1"), 8, 4)
    np.testing.assert_allclose(table["d1"].weights, alone.weights, atol=1e-9)
    for block in (7, 50_000):  # a dataset may be many blocks
        out = fc.score_per_dataset(samples, fitted, "dataset", ["node", "sample_id"], 8, 4, block).collect()
        assert len(out) == samples.count()
        inputs = {(r.node, r.sample_id): r.inputs for r in samples.collect()}
        for r in out[::9]:
            want = table[r.dataset](np.array([inputs[r.node, r.sample_id]], float))[0]
            assert r.prediction == pytest.approx(want.tolist())
    with pytest.raises(Exception, match="no model for d1"):
        fc.score_per_dataset(samples, fitted.where("dataset = 'd0'"), "dataset", ["node", "sample_id"], 8, 4).collect()


def test_scoring_contract(spark):
    samples = samples_of(waves(spark, 40, 2), 8, 4)
    seen = fc.score(samples, lambda x: np.full((len(x), 4), x.shape[1]), ["node", "sample_id"], 4, context=5)
    assert seen.first().prediction == [5.0] * 4
    with pytest.raises(Exception, match="expected"):
        fc.score(samples, lambda x: np.zeros((len(x), 3)), ["node", "sample_id"], 4).collect()
    joint = fc.score_jointly(samples, lambda x: np.repeat(x.mean(0, keepdims=True)[:, :4], len(x), axis=0), ["sample_id"], 4)
    rows = joint.where("sample_id = 0").orderBy("node").collect()
    assert [r.node for r in rows] == [0, 1] and rows[0].prediction == rows[1].prediction


def test_naive_models(spark):
    df = spark.createDataFrame([([1.0, 2.0, None, 4.0, 5.0, None, None, 8.0],), ([None] * 8,)], "inputs array<double>")
    rows = [r.prediction for r in models.with_seasonal_naive(df, 8, 4, 4).collect()]
    assert rows == [[5.0, 2.0, 4.0, 8.0], [None] * 4]
    assert df.select(models.persistence("inputs", 2).alias("p")).first().p == [8.0, 8.0]


def test_future_and_evaluation(spark):
    df = waves(spark, 120, 2)
    last = lambda x: np.repeat(x[:, -1:], 6, axis=1)
    future = fg.forecast_future(df, last, ["node"], "value", 24, 6, 3_600_000_000, 119).orderBy("node", "ts").collect()
    assert len(future) == 12 and future[0].ts.hour == 0 and future[0].ts.day == 6
    plain, table = fg.evaluate_splits(df, last, 120, (0.5, 0.25, 0.25), 12, 6, ["MAE", "WAPE"], [1, 6])
    assert {r.scope for r in table.collect()} == {"overall", "horizon_1", "horizon_6"}
    scaled, again = fg.evaluate_splits(df, last, 120, (0.5, 0.25, 0.25), 12, 6, ["MAE", "WAPE"], [1, 6], scale=True)
    a = {(r.split, r.scope, r.metric): r.value for r in table.collect()}
    b = {(r.split, r.scope, r.metric): r.value for r in again.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    kept, normal = fg.evaluate_splits(df, last, 120, (0.5, 0.25, 0.25), 12, 6, ["MAE"], scale=True, rescale=False)
    assert "target_unnorm" in kept.columns
    record = {r.split: r.scopes for r in fg.metric_record(table).collect()}
    assert set(record) == {"train", "valid", "test"} and "overall" in record["train"]


def test_grid(spark):
    """All combinations in one scan; a failing one is a row with its error and is never ranked."""
    samples = samples_of(waves(spark, 40, 2), 8, 4).repartition(3)

    def run(x, a, b):
        if a == 2 and b == "x":
            raise RuntimeError("no memory")
        if b == "short":
            return x[:, :2]
        return np.repeat(x[:, -1:], 4, 1) + a

    grid = sp.parameter_grid(spark, {"a": [3, 1, 2], "b": ["x", "yy", "short"]})
    results = fc.grid_search(samples, grid, run, 4)
    rows = {(r.a, r.b): r for r in results.collect()}
    assert len(rows) == 9 and [rows[a, b].combination for a, b in ((3, "x"), (3, "yy"), (1, "x"))] == [0, 1, 3]
    data = samples.collect()
    x, y = np.array([r.inputs for r in data], float), np.array([r.target for r in data], float)
    for (a, b), r in rows.items():
        if b == "short" or (a, b) == (2, "x"):
            assert r.metric is None and r.error.startswith("ValueError" if b == "short" else "RuntimeError: no memory")
        else:
            assert r.metric == pytest.approx(np.abs(x[:, -1:] + a - y).mean()) and r.error is None
    best = fc.rank_grid(results, top=2).collect()
    assert [(r.a, r.b) for r in best] == [(1, "x"), (1, "yy")]
    assert fc.failures(results).count() == 4


def test_argmax(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7], 1), ([0.9, 0.0, 0.1], 2)], "scores array<double>, label int")
    out = df.select(arrays.argmax("scores").alias("prediction"), F.col("label").alias("target"))
    assert [r.prediction for r in out.collect()] == [1, 0]
    assert out.agg(mt.accuracy()).first()[0] == 0.5
