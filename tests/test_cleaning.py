import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom import settings
from chronoloom.functions import scalars
from chronoloom.operators import gaps, impute, knn, outliers, profile as pf, quantiles, scalers as sc
from chronoloom.operators.spline import curvatures, spline_values, tridiagonal
from chronoloom.plans import cleaning as cl


def series(spark, values, name="s"):
    data = [(name, i, None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "series string, t long, v double")


def in_order(df, column="v"):
    return [r[column] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize("few", [1, 50, 10_000])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(0)
    groups = {"wide": rng.normal(0, 100, 3000), "ties": rng.integers(0, 5, 2000).astype(float), "one": np.array([4.0]),
              "skew": rng.exponential(5, 2500), "two": np.array([1.0, 2.0]), None: rng.normal(1e-300, 1e-301, 50),
              "tiny": np.array([5e-324, -5e-324, 1e-310, 0.0, -0.0, 2.0 ** -1022]), "near": 1.0 + np.arange(300) * 2.0 ** -52,
              "signs": np.array([-1.0, 1.0, -2.0, 2.0, -0.5, 0.5, 1e308, -1e308, 1024.0, 1023.9999999999999])}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("wide", float("nan")), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", probs, names, few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for n, p in zip(names, probs):
            assert got[g][n] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-320), (g, p)
    whole = quantiles.exact_quantiles(df, [], "v", [0.5], ["m"], few).first().m
    assert whole == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_order_key_is_the_order_of_doubles(spark):
    """Any bits but NaN: the key sorts as the value and gives it back exactly."""
    rng = np.random.default_rng(3)
    v = rng.integers(-(1 << 63), 1 << 63, 4000).view(np.float64)
    v = np.concatenate([v[~np.isnan(v)], 2.0 ** np.arange(-1074, 1024), -np.nextafter(2.0 ** np.arange(-1022, 1024), 0),
                        [np.inf, -np.inf, 0.0, -0.0, 5e-324, np.finfo(float).max]])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = df.select("v", quantiles.order_key(F.col("v")).alias("k")).withColumn("back", quantiles.value_of(F.col("k"))).toPandas()
    assert (got["back"] == got["v"]).all()
    size = np.abs(got["v"].to_numpy()).view(np.int64)
    assert (got["k"] == np.where(got["v"] < 0, -size, size)).all()


def test_quantiles_spread_a_hot_group(spark, monkeypatch):
    """Rows of a group that holds nearly all, half of them one value, do not meet in one task before they are counted."""
    seen = []
    join = quantiles.join_one

    def watched(rows, table, on, size, sizes):
        out = join(rows, table, on, size, rows_each=500, sizes=sizes)
        seen.append(out.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first())
        return out

    monkeypatch.setattr(quantiles, "join_one", watched)
    df = spark.range(40_000).select(F.when(F.col("id") < 39_000, "hot").otherwise(F.col("id").cast("string")).alias("g"),
                                    F.when(F.col("id") % 2 == 0, 7.0).otherwise(F.sqrt("id") + 1.0).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = quantiles.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.9], ["a", "b", "c"], few=100).where("g = 'hot'").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    i = np.arange(39_000)
    assert [got.a, got.b, got.c] == pytest.approx(np.quantile(np.where(i % 2 == 0, 7.0, np.sqrt(i) + 1), [0.25, 0.5, 0.9]))
    assert all(most < 0.2 * total or total < 1000 for most, total in seen) and len(seen) > 1


def test_scalar_functions(spark):
    df = spark.createDataFrame([("\x01 12.5\x7f", 2.5, 1e308), ("abc", -1.0, 0.0), ("NaN", 0.125, 1.0)], "s string, v double, w double")
    rows = df.select(scalars.to_number(scalars.strip_control("s")).alias("n"), scalars.round_to("v", 0).alias("r"),
                     scalars.positive_or_null("v").alias("p"), scalars.clip("v", F.lit(0.0), F.lit(2.0)).alias("c"),
                     scalars.log1p_clamped("v").alias("l"), scalars.round_to("v", F.lit(2)).alias("r2")).collect()
    assert [r.n for r in rows] == [12.5, None, None]
    assert [r.r for r in rows] == [2.0, -1.0, 0.0] and rows[2].r2 == 0.12
    assert [r.p for r in rows] == [2.5, None, 0.125]
    assert [r.c for r in rows] == [2.0, 0.0, 0.125]
    assert rows[1].l == 0.0 and rows[0].l == pytest.approx(np.log1p(2.5))
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r[0] for r in bad.select(scalars.finite_or_zero("v")).collect()] == [0.0, 0.0, 1.0]
    assert [r[0] for r in bad.select(scalars.finite_or_null("v")).collect()] == [None, None, 1.0]
    from chronoloom.operators.panel import check_finite

    assert tuple(check_finite(bad, "v").first()) == (True, True)
    with pytest.raises(ValueError):
        check_finite(bad, "v", raise_ex=True)


def test_runs_at_the_threshold(spark):
    v = np.arange(200, dtype=float)
    for start, n in ((5, 29), (40, 30), (80, 50), (150, 50)):
        v[start:start + n] = np.nan
    df = series(spark, v)
    r = gaps.missing_runs(df, ["series"], "t", "v", chunk=16).first()
    assert (r.max_consecutive, r.consecutive_gaps) == (50, 4)
    assert r.avg_consecutive == pytest.approx(159 / 4) and r.missing_rate == pytest.approx(159 / 2)
    kept = gaps.drop_long_gaps(df.withColumn("indicator", F.lit("ph")), ["series", "indicator"], ["series"], "t", "v", 30, ["ph"], chunk=16)
    assert sorted(x.t for x in kept.collect()) == [t for t in range(200) if not (40 <= t < 70 or 80 <= t < 130 or t >= 150)]
    ignored = gaps.drop_long_gaps(df.withColumn("indicator", F.lit("odd")), ["series", "indicator"], ["series"], "t", "v", 30, ["ph"])
    assert ignored.count() == 200


def test_outlier_rules(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(10, 1, 60)
    v[7], v[20] = 30.0, -20.0
    df = series(spark, v)
    s = pd.Series(v)
    z = np.abs((s - s.mean()) / s.std()) > 3
    assert [x is None for x in in_order(outliers.zscore_outliers(df, ["series"], "v", 3.0))] == z.tolist()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    far = (s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))
    assert [x is None for x in in_order(outliers.iqr_outliers(df, ["series"], "v"))] == far.tolist()
    few = series(spark, [1.0] * 8 + [99.0])
    assert None not in in_order(outliers.zscore_outliers(few, ["series"], "v", 1.0))


@pytest.mark.parametrize("chunk", [4, 1000])
def test_linear_and_fill(spark, chunk):
    v = [None, 2.0, None, None, 8.0, None, None]
    df = series(spark, [np.nan if x is None else x for x in v])
    expected = pd.Series(v, dtype=float).interpolate("linear")
    got = in_order(impute.interpolate_linear(df, ["series"], "t", "v", chunk))
    assert got[0] is None and got[1:] == pytest.approx(expected.tolist()[1:])
    assert in_order(impute.fill_both_ways(df, ["series"], "t", "v", chunk)) == [2.0, 2.0, 2.0, 2.0, 8.0, 8.0, 8.0]


def test_time_interpolation(spark):
    stamps = ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 04:00:00", "2024-01-01 05:00:00"]
    data = [("s", i, s, v) for i, (s, v) in enumerate(zip(stamps, [1.0, None, 9.0, None]))]
    df = spark.createDataFrame(data, "series string, t long, s string, v double").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    assert in_order(impute.interpolate_time(df, ["series"], "t", "ts", "v")) == pytest.approx([1.0, 3.0, 9.0, 9.0])


def dense_spline(x, y, at):
    """Not-a-knot through all points by one dense solve of the piecewise coefficients."""
    n = len(x)
    a, b = np.zeros((4 * (n - 1), 4 * (n - 1))), np.zeros(4 * (n - 1))
    row = 0
    def basis(i, t, d=0):
        u = t - x[i]
        return [[1, u, u**2, u**3], [0, 1, 2 * u, 3 * u**2], [0, 0, 2, 6 * u], [0, 0, 0, 6]][d]
    for i in range(n - 1):
        for t, v in ((x[i], y[i]), (x[i + 1], y[i + 1])):
            a[row, 4 * i:4 * i + 4], b[row] = basis(i, t), v
            row += 1
    for i in range(n - 2):
        for d in (1, 2):
            a[row, 4 * i:4 * i + 4] = basis(i, x[i + 1], d)
            a[row, 4 * i + 4:4 * i + 8] = -np.array(basis(i + 1, x[i + 1], d))
            row += 1
    for i in (0, n - 3):
        if row < len(b):
            a[row, 4 * i:4 * i + 4] = basis(i, x[i + 1], 3)
            a[row, 4 * i + 4:4 * i + 8] = -np.array(basis(i + 1, x[i + 1], 3))
            row += 1
    c = np.linalg.lstsq(a, b, rcond=None)[0].reshape(-1, 4)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u = at - x[i]
    return c[i, 0] + c[i, 1] * u + c[i, 2] * u**2 + c[i, 3] * u**3


@pytest.mark.parametrize("n, keep", [(12, 4), (40, 25), (300, 230)])
def test_spline_against_dense_solve(spark, n, keep):
    rng = np.random.default_rng(n)
    known = np.sort(rng.choice(np.arange(1, n - 1), keep, replace=False))
    v = np.full(n, np.nan)
    v[known] = rng.normal(0, 1, keep)
    df = series(spark, v).withColumn("x", F.col("t").cast("double"))
    missing = np.flatnonzero(np.isnan(v))
    expected = dense_spline(known.astype(float), v[known], missing.astype(float))
    # small blocks, so that a series spans many of them, some with a single knot, also at the ends
    for block in (8192, 32, 5, 2, 1):
        got = {r.t: r.s for r in spline_values(df, ["series"], "t", "x", "v", "s", block=block).collect()}
        assert [got[t] for t in missing] == pytest.approx(expected.tolist(), rel=1e-6, abs=1e-6)
        assert all(got[t] is None for t in known)


def test_spline_of_many_series(spark):
    """Series of every length together, NULL keys aside, one with repeated positions; microseconds as axis."""
    rng = np.random.default_rng(5)
    data, want = [], {}
    for k in range(25):
        n = int(rng.integers(4, 60))
        x = np.cumsum(rng.integers(1, 9, n)) * 3_600_000_000.0 + 1.6e15
        y = rng.normal(0, 1, n)
        known = rng.random(n) < 0.6
        known[:4] = True
        data += [(f"s{k}", i, float(x[i]), float(y[i]) if known[i] else None) for i in range(n)]
        if (~known).any():
            scaled = (x - x[0]) / 3.6e9
            want[f"s{k}"] = dict(zip(np.flatnonzero(~known).tolist(), dense_spline(scaled[known], y[known], scaled[~known]).tolist()))
    data += [("twice", i, 1.0, 2.0) for i in range(6)] + [("twice", 6, 1.0, None)]
    df = spark.createDataFrame(data, "series string, t long, x double, v double")
    for block in (4, 1000):
        rows = spline_values(df, ["series"], "t", "x", "v", "s", block=block).where("v IS NULL").collect()
        got = {}
        for r in rows:
            got.setdefault(r.series, {})[r.t] = r.s
        assert got.pop("twice") == {6: None}
        assert got.keys() == want.keys()
        for name in want:
            assert got[name] == pytest.approx(want[name], rel=1e-6, abs=1e-6)


def test_tridiagonal_equals_dense():
    rng = np.random.default_rng(2)
    n = 700
    low, up, mid = rng.normal(0, 1, n), rng.normal(0, 1, n), rng.uniform(2.5, 6, n) * rng.choice([-1, 1], n)
    mid = np.sign(mid) * (np.abs(low) + np.abs(up) + 0.05)
    low[0] = up[-1] = low[300] = up[299] = 0
    rhs = rng.normal(0, 1, (n, 3))
    full = np.diag(mid) + np.diag(up[:-1], 1) + np.diag(low[1:], -1)
    assert tridiagonal(low, mid, up, rhs) == pytest.approx(np.linalg.solve(full, rhs), rel=1e-9, abs=1e-9)


def test_spline_deals_rows_by_chunk(spark):
    """With no broadcast the rows of a long series are exchanged by series and chunk or position, never by series alone."""
    df = series(spark, [float(i % 7) if i % 3 else np.nan for i in range(3000)]).withColumn("x", F.col("t").cast("double"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        config = settings.indicator_config(spark)
        rows = df.withColumn("indicator", F.lit("water_temp"))
        plans = [spline_values(df, ["series"], "t", "x", "v", "s", block=100), impute.fill_chain(rows, config, ["series", "indicator"], "t", "v", chunk=100)]
        for out in plans:
            text = out._jdf.queryExecution().executedPlan().toString()
            spread = [m for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)]
            assert any("_chunk" in m for m in spread)
            tasks = out.groupBy(F.spark_partition_id()).count().collect()
            assert len(tasks) > 1 and max(r["count"] for r in tasks) < 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_spline_needs_four(spark):
    df = series(spark, [1.0, np.nan, 2.0, 5.0]).withColumn("x", F.col("t").cast("double"))
    assert in_order(spline_values(df, ["series"], "t", "x", "v", "s"), "s") == [None] * 4


def test_curvature_is_linear_for_a_cubic():
    x = np.array([0.0, 1.0, 2.5, 3.0, 7.0, 8.0])
    assert curvatures(x, x**3) == pytest.approx(6 * x, abs=1e-9)


def test_fill_chain(spark):
    config = settings.indicator_config(spark)
    v = [np.nan, 10.0, 11.0, np.nan, 13.0, 30.0, np.nan, 49.0, np.nan, np.nan]
    one = series(spark, v, "a").withColumn("indicator", F.lit("water_temp"))
    two = series(spark, [np.nan, 7.0, np.nan, 8.0], "a").withColumn("indicator", F.lit("ph"))
    odd = series(spark, [np.nan, 7.0, np.nan, 8.0], "a").withColumn("indicator", F.lit("other"))
    lone = series(spark, [np.nan, 7.0, np.nan], "b").withColumn("indicator", F.lit("ph"))
    rows = one.unionByName(two).unionByName(odd).unionByName(lone)
    skip = impute.fill_chain(rows, config, ["series", "indicator"], "t", "v")
    known = np.flatnonzero(~np.isnan(v))
    at = np.flatnonzero(np.isnan(v)).astype(float)
    expected = np.clip(dense_spline(known.astype(float), np.array(v)[known], at), 0, 50)
    got = in_order(skip.where("indicator = 'water_temp'"))
    assert [got[int(t)] for t in at] == pytest.approx(expected.tolist(), abs=1e-6)
    assert in_order(skip.where("series = 'a' and indicator = 'ph'")) == pytest.approx([7.0, 7.0, 7.5, 8.0])
    assert in_order(skip.where("indicator = 'other'")) == [None, 7.0, None, 8.0]
    assert in_order(skip.where("series = 'b'")) == [None, 7.0, None]
    fill = impute.fill_chain(rows, config, ["series", "indicator"], "t", "v", sparse="fill")
    assert in_order(fill.where("series = 'b'")) == [7.0, 7.0, 7.0]
    with pytest.raises(ValueError):
        impute.fill_chain(rows, config, ["series", "indicator"], "t", "v", sparse="?")


def brute_knn(x, k=5):
    mean, std = np.nanmean(x, 0), np.nanstd(x, 0)
    std[std == 0] = 1
    z = (x - mean) / std
    out = z.copy()
    for i, j in zip(*np.where(np.isnan(z))):
        found = []
        for r in range(len(z)):
            both = ~np.isnan(z[i]) & ~np.isnan(z[r])
            if not np.isnan(z[r, j]) and both.any():
                d = np.sqrt(x.shape[1] / both.sum() * ((z[i] - z[r])[both] ** 2).sum())
                found.append((round(d, 9), r, z[r, j]))
        best = sorted(found)[:k]
        out[i, j] = np.mean([b[2] for b in best]) if best else 0.0
    return out * std + mean


@pytest.mark.parametrize("block, fan", [(7, 3), (40, 32), (2048, 32)])
def test_nearest_neighbours(spark, block, fan):
    rng = np.random.default_rng(9)
    columns = ["a", "b", "c"]
    stations, data = {}, []
    for s, n in (("one", 150), ("two", 30), ("tiny", 3)):
        x = rng.normal(0, 1, (n, 3)) * [1, 5, 20] + rng.integers(0, 3, (n, 1)) * 4
        x[rng.random(x.shape) < 0.35] = np.nan
        x[0] = [1.0, 2.0, 3.0]
        stations[s] = x
        data += [(s, i, *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(data, "station string, row long, a double, b double, c double")
    out = knn.knn_impute(df, ["station"], "row", columns, block=block, fan=fan)
    assert out.count() == len(data)
    for s, x in stations.items():
        got = np.array([[r[c] for c in columns] for r in out.where(F.col("station") == s).orderBy("row").collect()])
        assert got == pytest.approx(brute_knn(x), abs=1e-9)


def test_box_bounds_hold():
    """No pair of rows is nearer or farther than the boxes of their nodes say; mixed patterns included."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        w = int(rng.integers(1, 6))
        q, d = rng.normal(0, 2, (6, w)), rng.normal(1, 2, (9, w))
        q[rng.random(q.shape) < 0.4] = np.nan
        d[rng.random(d.shape) < 0.4] = np.nan
        if (np.isnan(q).all(0) | np.isnan(d).all(0)).all():
            continue
        box = lambda x: (np.where(np.isnan(x).all(0), np.nan, np.nanmin(np.where(np.isnan(x), np.inf, x), 0)),
                         np.where(np.isnan(x).all(0), np.nan, np.nanmax(np.where(np.isnan(x), -np.inf, x), 0)), ~np.isnan(x).any(0))
        (lo, hi, whole), (a, b, c) = box(d), box(q)
        near, far, sure, shared = knn.bounds({"lo": a, "hi": b, "whole": c}, lo[None], hi[None], whole[None])
        for x in q:
            for y in d:
                both = ~np.isnan(x) & ~np.isnan(y)
                if both.any():
                    dist = w / both.sum() * ((x - y)[both] ** 2).sum()
                    assert near[0] - 1e-9 <= dist <= far[0] + 1e-9 and shared[0]
                else:
                    assert not sure[0]


def test_neighbours_of_many_columns(spark):
    """More columns than a long has bits."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 70))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[0] = 0.5
    names = [f"c{j}" for j in range(70)]
    df = spark.createDataFrame([("s", i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                               "station string, row long, " + ", ".join(f"{c} double" for c in names))
    got = np.array([[r[c] for c in names] for r in knn.knn_impute(df, ["station"], "row", names, block=16, fan=2).orderBy("row").collect()])
    assert got == pytest.approx(brute_knn(x), abs=1e-9)


def test_leaves_beyond_reach_are_passed_over(monkeypatch):
    """Only donors that may be among the k nearest are measured; ties go to the smaller id."""
    rng = np.random.default_rng(3)
    near, far = rng.normal(0, 1, (40, 3)), rng.normal(100, 1, (40, 3))
    near[::2, 0], far[::3, 1] = np.nan, np.nan
    asking = knn.Asking(np.arange(40), near.ravel(), 3, 5)
    measured = []
    kept = knn.Asking._keep
    monkeypatch.setattr(knn.Asking, "_keep", lambda self, new: (measured.append(len(new[0])), kept(self, new)))
    asking.meet(np.arange(40), near)
    asking.meet(np.arange(40, 80), far)
    asking.meet(np.arange(80, 120), near)  # copies: nothing nearer, but as near
    assert len(measured) == 2 and measured[0] < 20 * 20
    want = brute_knn(np.vstack([near, far, near]))
    x = np.vstack([near, far, near])
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    asking = knn.Asking(np.arange(40), z[:40].ravel(), 3, 5)
    for part in (0, 40, 80):
        asking.meet(np.arange(part, part + 40), z[part:part + 40])
    for i, fills in asking.means():
        got = fills[0] * np.nanstd(x[:, 0]) + np.nanmean(x[:, 0])
        assert got == pytest.approx(want[asking.ids[i], 0], abs=1e-9) and fills[1] is None


def test_searches_are_spread(spark, monkeypatch):
    """A small table of many pairs is dealt over as many tasks as its pairs need, not merged into one."""
    monkeypatch.setattr(knn, "PAIRS", 2)
    dealt = []
    search = knn.leaf_search
    monkeypatch.setattr(knn, "leaf_search", lambda both, *rest: (dealt.append(both.rdd.getNumPartitions()), search(both, *rest))[1])
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("s", i, float(a), None if i % 2 else float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (200, 2)))],
                               "station string, row long, a double, b double")
    assert knn.knn_impute(df, ["station"], "row", ["a", "b"], block=10).where("b IS NULL").count() == 0
    assert dealt[1] > 4


def test_donors_are_sent_once_to_a_group(spark, monkeypatch):
    """Leaves that ask for the same donors share them, so that what is exchanged does not grow with the pairs of leaves."""
    sent, search, paired, pairs = [], knn.leaf_search, [], knn.candidate_pairs
    monkeypatch.setattr(knn, "leaf_search", lambda both, *rest: (sent.append(both.count()), search(both, *rest))[1])
    monkeypatch.setattr(knn, "candidate_pairs", lambda *a: (found := pairs(*a), paired.append(found.count()))[0])
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (300, 3)).astype(float)  # many are as near as others
    x[rng.random(x.shape) < 0.4] = np.nan
    x[0] = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([("s", i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                               "station string, row long, a double, b double, c double")
    out = knn.knn_impute(df, ["station"], "row", ["a", "b", "c"], block=4).orderBy("row").collect()
    assert np.array([r[2:] for r in out], dtype=float) == pytest.approx(brute_knn(x), abs=1e-9)
    assert sent[1] < 0.5 * paired[0]


@pytest.mark.parametrize("name", [int, str])
def test_donors_in_order_are_those_of_all_pairs(monkeypatch, name):
    """Rows that look along one coordinate find the donors that products of all pairs find, ties included."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (600, 3)), rng.integers(-2, 3, (600, 3))])
    x[rng.random(x.shape) < 0.35] = np.nan
    ids, found = np.array([name(i) for i in rng.permutation(len(x))], dtype=object if name is str else int), []
    for worth in (0, np.inf):
        monkeypatch.setattr(knn, "WORTH", worth)
        asking = knn.Asking(ids[100:700], x[100:700].ravel(), 3, 5)
        for part in range(0, len(x), 150):
            asking.meet(ids[part:part + 150], x[part:part + 150])
        found.append((list(asking.means()), asking.reach.tolist()))
    assert found[0] == found[1] and len(found[0][0]) > 300


def test_scalers_round_trip(spark):
    rng = np.random.default_rng(11)
    data = [(n, t, float(rng.normal(n, n + 1)), 0.5) for n in range(4) for t in range(100)] + [(9, t, 3.0, 0.5) for t in range(100)]
    df = spark.createDataFrame(data, "node int, t_idx long, value double, tod double")
    steps = sc.train_steps(100, 0.8)
    for keys in (["node"], []):
        stats = sc.zscore_fit(df, keys, "value", steps)
        scaled = sc.zscore_transform(df, stats, keys, "value")
        moments = scaled.where(F.col("t_idx") < steps).groupBy(*keys).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
        for r in moments:
            assert r.m == pytest.approx(0, abs=1e-9)
            assert r.s == pytest.approx(0 if keys and r.node == 9 else 1, abs=1e-9)
        back = sc.zscore_inverse(scaled, stats, keys, "value", "back").join(df.withColumnRenamed("value", "old"), ["node", "t_idx"])
        assert back.where(F.abs(F.col("back") - F.col("old")) > 1e-9).count() == 0
        assert scaled.where("tod <> 0.5").count() == 0
    stats = sc.minmax_fit(df, ["node"], "value", steps)
    scaled = sc.minmax_transform(df, stats, ["node"], "value", "s")
    inside = scaled.where((F.col("t_idx") < steps) & (F.col("node") != 9))
    assert inside.where("s < 0 or s > 1").count() == 0
    assert scaled.where("node = 9 and s is not null").count() == 0
    back = sc.minmax_inverse(scaled, stats, ["node"], "s", "b")
    assert back.where("node <> 9 and abs(b - value) > 1e-9").count() == 0


def test_rescale_policy(spark):
    df = spark.createDataFrame([(0, 1.0), (0, -1.0)], "node int, prediction double")
    stats = spark.createDataFrame([(0, 10.0, 2.0)], "node int, mean double, std double")
    kept = [tuple(r) for r in sc.rescale_policy(df, stats, ["node"], ["prediction"], False).select("prediction", "prediction_unnorm").collect()]
    assert kept == [(1.0, 12.0), (-1.0, 8.0)]
    back = [tuple(r) for r in sc.rescale_policy(df, stats, ["node"], ["prediction"], True).select("prediction", "prediction_unnorm").collect()]
    assert back == [(12.0, 12.0), (8.0, 8.0)]
    same = sc.rescale_policy(df, None, ["node"], ["prediction"], False).first()
    assert same.prediction == same.prediction_unnorm


def chain_by_hand(s, log, minmax):
    lo, hi = s.quantile(0.01), s.quantile(0.99)
    clipped = s.clip(lo, hi)
    x = np.log1p(np.maximum(clipped, 0)) if log else clipped
    iqr = x.quantile(0.75) - x.quantile(0.25)
    iqr = iqr if iqr != 0 else (x.std() if x.std() != 0 else 1.0)
    x = (x - x.median()) / iqr
    if minmax:
        x = x * 0.0 if x.max() == x.min() else (x - x.min()) / (x.max() - x.min())
    return clipped, x


def test_rows_do_not_meet_by_column(spark):
    """Rows stay where they are: a column may hold a quarter of all values."""
    df = spark.createDataFrame([("a" if i % 2 else "b", float(i)) for i in range(40)], "column string, value double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        meta = sc.fit_chain(df, ["column"], "value", ["a"], rescale_minmax=True)
        chain = sc.apply_chain(df, meta, ["column"], "value")
        made = [sc.minmax_column(df, ["column"], "value"), sc.robust_scale(df, ["column"], "value"),
                sc.winsorize(df, ["column"], "value"), chain, sc.invert_chain(chain, meta, ["column"], "value")]
        for out in made:
            assert "hashpartitioning(column" not in out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("minmax", [False, True])
def test_transform_chain_and_back(spark, minmax):
    rng = np.random.default_rng(13)
    columns = {"x": rng.exponential(50, 400), "constant": np.full(400, 2.0), "few": np.r_[np.zeros(390), np.arange(10.0)]}
    columns["x"][3] = np.inf
    data = [(c, i, float(v)) for c, vs in columns.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "column string, i int, value double")
    meta = sc.fit_chain(df, ["column"], "value", ["x"], rescale_minmax=minmax)
    out = sc.apply_chain(df, meta, ["column"], "value")
    back = sc.invert_chain(out, meta, ["column"], "value")
    for c, vs in columns.items():
        s = pd.Series(vs).replace([np.inf, -np.inf], np.nan)
        clipped, x = chain_by_hand(s, c == "x", minmax)
        got = pd.Series([r.value for r in out.where(F.col("column") == c).orderBy("i").collect()], dtype=float)
        np.testing.assert_allclose(got, x, atol=1e-9)
        restored = pd.Series([r.value for r in back.where(F.col("column") == c).orderBy("i").collect()], dtype=float)
        if not (minmax and clipped.max() == clipped.min()):
            np.testing.assert_allclose(restored, clipped, atol=1e-6)


def test_several_datasets(spark):
    a = spark.createDataFrame([("k", 1.0, 2.0)], "id string, x double, y double")
    b = spark.createDataFrame([("l", 3.0)], "id string, x double")
    long = sc.chain_datasets({"a": a, "b": b}, ["x", "y"], row="id")
    assert sorted((r.dataset, r.row, r["column"], r.value) for r in long.collect()) == [
        ("a", "k", "x", 1.0), ("a", "k", "y", 2.0), ("b", "l", "x", 3.0)]
    assert sc.paired([1], [2]) == [(1, 2)]
    with pytest.raises(ValueError):
        sc.paired([1], [])


def test_standardise_skips_missing(spark):
    df = series(spark, [1.0, np.nan, 3.0])
    scaled, stats = sc.standardise(df, ["series"], "v")
    assert in_order(scaled) == [-1.0, None, 1.0]
    assert tuple(stats.select("mean", "std").first()) == (2.0, 1.0)


def test_profile(spark):
    rng = np.random.default_rng(17)
    x = rng.exponential(2, 300)
    x[5], x[6], x[7] = 0.0, np.nan, np.inf
    df = spark.createDataFrame([(float(v), 1, "s") for v in x], "x double, k int, s string")
    assert pf.numeric_columns(df) == ["x", "k"]
    wide = df.select(*[F.col("k").alias(f"c{j}") for j in range(25)])
    assert len(pf.numeric_columns(wide)) == 25 and len(pf.numeric_columns(wide, 20)) == 20
    r = pf.column_profile(df, ["x"]).first()
    s = pd.Series(x).replace([np.inf, -np.inf], np.nan)
    d = s.describe(percentiles=[0.01, 0.05, 0.5, 0.95, 0.99])
    assert r["count"] == 298 and r["std"] == pytest.approx(d["std"]) and r.p01 == pytest.approx(d["1%"])
    assert r["skew"] == pytest.approx(s.skew()) and r.kurt == pytest.approx(s.kurt())
    assert r.missing_ratio == pytest.approx(2 / 300) and r.zero_ratio == pytest.approx(1 / 300)


def sensor(spark, n=260):
    rng = np.random.default_rng(21)
    data = []
    for station in ("s1", "s2"):
        for name, centre in (("water_temp", 20.0), ("ph", 7.0), ("other", 1.0)):
            v = centre + rng.normal(0, 1, n)
            v[rng.random(n) < 0.3] = np.nan
            if name == "ph" and station == "s1":
                v[100:155] = np.nan
                v[10] = 60.0
            data += [(station, t, name, None if np.isnan(x) else float(x)) for t, x in enumerate(v)]
    return spark.createDataFrame(data, "station string, t_idx long, indicator string, value double")


@pytest.mark.parametrize("strategy, gone", [("conservative", 1), ("segmented", 0), ("aggressive", 1)])
def test_clean_stations(spark, strategy, gone):
    config = settings.indicator_config(spark).where("indicator in ('water_temp', 'ph')")
    out = cl.clean_stations(sensor(spark), config, strategy)
    got = out.toPandas()
    per = got[got.indicator == "ph"].groupby("station").size()
    assert (per["s1"] < 260) == bool(gone) and per["s2"] == 260
    done = got[got.indicator != "other"]
    assert done.value.notna().all()
    assert got[got.indicator == "other"].value.isna().any()
    assert (done[(done.station == "s1") & (done.indicator == "ph")].value < 59).all()
    ph = done[done.indicator == "ph"].value
    np.testing.assert_allclose(ph, ph.round(2), atol=1e-9)
    s1 = got[(got.station == "s1") & (got.indicator == "ph")].sort_values("pos")
    assert s1.pos.tolist() == list(range(len(s1)))
    report = {r.station: r for r in cl.cleaning_report(sensor(spark), out).collect()}
    assert report["s2"].retention_pct == 100.0 and report["s1"].longest_gap >= 55


def test_batch_clean(spark):
    config = settings.indicator_config(spark).where("indicator in ('water_temp', 'ph')")
    cleaned, report = cl.batch_clean(sensor(spark), config)
    got = {(r.strategy, r.station): r for r in report.collect()}
    assert len(got) == 6 and all(r.status == "success" for r in got.values())
    assert got["segmented", "s1"].retention_pct == 100.0 and got["aggressive", "s1"].retention_pct < 100.0
    single = cl.clean_stations(sensor(spark), config, "conservative").toPandas()
    both = cleaned.where("strategy = 'conservative'").toPandas()
    key = ["station", "t_idx", "indicator"]
    a, b = single.sort_values(key).reset_index(drop=True), both.sort_values(key).reset_index(drop=True)
    np.testing.assert_allclose(a.value, b.value, atol=1e-9)


@pytest.mark.parametrize("method", ["iqr", "zscore", "none"])
def test_enhanced_cleaning(spark, method):
    rows = []
    for t in range(40):
        text = {3: "abc", 5: "0", 6: "-4", 9: "\x0199\x02", 12: "500"}.get(t, f"\x01{20 + t % 5}.{t % 10}")
        stamp = f"2024-01-{1 + t // 24:02d} {t % 24:02d}:00:00"
        rows += [("s", t, stamp, "water_temp", text), ("s", t, stamp, "extra", "1.234567")]
    df = spark.createDataFrame(rows, "station string, t_idx long, t string, indicator string, raw string").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    out = cl.enhanced_cleaning(df, settings.indicator_config(spark), method=method, factor=1.5)
    temp = [r.value for r in out.where("indicator = 'water_temp'").orderBy("t_idx").collect()]
    assert None not in temp and max(temp) <= 50.0 and min(temp) > 0
    assert {r.value for r in out.where("indicator = 'extra'").collect()} == {1.2346}
    with pytest.raises(ValueError):
        cl.enhanced_cleaning(df, settings.indicator_config(spark), method="?")


def test_quality_report(spark):
    config = settings.indicator_config(spark)
    df = spark.createDataFrame([("ph", 7.0), ("ph", 15.0), ("ph", None), ("turbidity", None), ("odd", 1.0)], "indicator string, value double")
    rows = pf.quality_report(df, config).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.indicator, r.total, r.missing, r.valid, r.out_of_range, r.in_range) == ("ph", 3, 1, 2, 1, False)


def test_settings(spark):
    assert settings.regular_settings(spark, "PEMS04").input_len == 12
    assert settings.dataset_settings(spark).count() == 22
    with pytest.raises(KeyError):
        settings.regular_settings(spark, "nope")
    assert settings.strategies(spark).count() == 3 and settings.strategy("segmented") == (100, 3.5)
    with pytest.raises(ValueError):
        settings.strategy("nope")
    assert settings.indicator_names()["水温"] == "water_temp"


def test_only_rows_with_a_value_meet_the_knots(spark):
    """Rows without a value are no knots and are not joined; none is lost."""
    from chronoloom.operators.spline import with_curvatures

    rows = spark.createDataFrame([("a", i, float(i) if i % 5 == 0 else None) for i in range(50)], "s string, pos long, value double")
    # a knot where no value is would be found only if the other rows were joined too
    knots = spark.createDataFrame([("a", 0, 0.5), ("a", 3, 9.0), ("a", 45, 1.5)], "s string, _at long, _m double")
    got = {r.pos: r._m for r in with_curvatures(rows, knots, ["s"], "pos", "value").collect()}
    assert len(got) == 50 and got[0] == 0.5 and got[45] == 1.5 and got[3] is None


def test_cleaning_carries_only_what_it_returns(spark, monkeypatch):
    from chronoloom.operators import gaps
    from chronoloom.plans import cleaning as cl

    seen = []
    drop = gaps.drop_long_gaps
    monkeypatch.setattr(cl.gaps, "drop_long_gaps", lambda long, *rest: (seen.append(long.columns), drop(long, *rest))[1])
    long = spark.createDataFrame([("s", i, "a", float(i), "x" * 100) for i in range(20)], "station string, t_idx long, indicator string, value double, note string")
    config = spark.createDataFrame([("a", 3, 0.0, 300.0, "linear")], "indicator string, decimals int, min_val double, max_val double, interpolation string")
    assert cl.clean_stations(long, config, "segmented").count() == 20
    assert seen == [["station", "t_idx", "indicator", "value"]]


def test_long_gaps_are_found_from_the_valid_rows(spark, monkeypatch):
    from chronoloom.operators import gaps
    from chronoloom.settings import STRATEGIES
    from chronoloom.plans import cleaning as cl

    rng = np.random.default_rng(11)
    rows, gone = [], {g: set() for g in (30, 50, 100)}
    for s in ["a", "b", None]:
        for name, share in (("ph", 0.03), ("do", 0.01), ("none", 0.0), ("odd", 0.001)):
            first, n = (0, 400) if name != "do" else (7, 380)
            there = rng.random(n) < share
            run = []
            for t in range(n + 1):
                if t == n or there[t]:
                    for g in gone:
                        # nothing is known of a station without a name, and odd is not configured
                        if len(run) >= g and s and name in ("ph", "do"):
                            gone[g] |= {(s, x) for x in run}
                    run = []
                else:
                    run.append(first + t)
            rows += [(s, name, first + t, 1.0 if there[t] else None) for t in range(n) if name != "none" or s == "c"]
    df = spark.createDataFrame(rows, "station string, indicator string, t_idx long, value double")
    # the missing rows, most of a sparse series, need no neighbours
    monkeypatch.setattr(gaps, "valid_neighbours", lambda *a, **k: pytest.fail("rows were put in order"))
    where = lambda out: sorted((r.station or "", r.indicator, r.t_idx) for r in out.collect())
    for g, chunk in ((30, 16), (50, 64), (100, 65_536)):
        kept = gaps.drop_long_gaps(df, ["station", "indicator"], ["station"], "t_idx", "value", g, ["ph", "do"], chunk=chunk)
        assert kept.columns == df.columns
        assert where(kept) == sorted((s or "", i, t) for s, i, t, _ in rows if (s, t) not in gone[g])
    found = cl.strategies_without_gaps(df, ["ph", "do"])
    for name, g, z, _ in STRATEGIES:
        mine = found.where(F.col("strategy") == name)
        assert where(mine) == sorted((s or "", i, t) for s, i, t, _ in rows if (s, t) not in gone[g])
        assert {r.z_limit for r in mine.select("z_limit").distinct().collect()} == {z}


def test_a_gap_of_no_step_removes_every_step(spark):
    df = series(spark, np.array([1.0, np.nan, 2.0]))
    assert gaps.drop_long_gaps(df, ["series"], ["series"], "t", "v", 0).count() == 0


def test_statistics_come_with_the_positions(spark):
    from chronoloom.operators.timeaxis import reindex

    rows = spark.createDataFrame([(s, 3 * t, float(t)) for s in "ab" for t in range(50)], "s string, t long, v double")
    stats = outliers.zscore_stats(rows, ["s"], "v")
    out = reindex(rows, ["s"], "t", "p", chunk=16, series=stats)
    assert sorted((r.s, r.t, r.p, r._n, r._mean) for r in out.collect()) == [(s, 3 * t, t, 50, 24.5) for s in "ab" for t in range(50)]
    far = outliers.zscore_outliers(out, ["s"], "v", 1.5, beside=True)
    assert in_order(far.where("s = 'a'")) == in_order(outliers.zscore_outliers(rows.where("s = 'a'"), ["s"], "v", 1.5))


def test_rows_are_made_wide_in_one_exchange(spark, monkeypatch):
    from chronoloom.plans import cleaning as cl

    plans = []
    monkeypatch.setattr(cl, "stage", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df)[1])
    rows = spark.createDataFrame(
        [("s", t, t, i, None if (t + len(i)) % 3 == 0 else float(t)) for t in range(12) for i in ("a", "bb")] + [("s", 12, 12, "odd", 5.0)],
        "station string, t_idx long, pos long, indicator string, value double")
    got = cl.fill_by_neighbours(rows, ["a", "bb"], ["station"], k=1)
    found = {(r.t_idx, r.indicator): r.value for r in got.collect()}
    assert plans[0].count("Exchange hashpartitioning") == 1
    # a step that only other columns have is filled like any other
    assert len(found) == 27 and found[12, "odd"] == 5.0 and found[12, "a"] is not None and found[1, "a"] == 1.0


def test_only_the_ends_of_chunks_are_exchanged_beside_the_rows(spark):
    from chronoloom.operators.timeaxis import valid_neighbours

    rows = spark.createDataFrame([("a", t, float(t) if t % 4 == 0 else None, -float(t)) for t in range(40)], "s string, t long, v double, axis double")
    out = valid_neighbours(rows, ["s"], "t", "v", chunk=8, extra=["axis"])
    assert out._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    got = {r.t: (r.prev.pos, r.next and r.next.pos, r.prev.axis, r.series_last) for r in out.collect()}
    assert got == {t: (t // 4 * 4, -(-t // 4) * 4 if t <= 36 else None, -float(t // 4 * 4), 39) for t in range(40)}


def test_strategies_stand_beside_each_other(spark, monkeypatch):
    """A row is staged once, whatever the number of strategies that keep it; positions and outliers are each strategy's own."""
    config = settings.indicator_config(spark).where("indicator in ('water_temp', 'ph')")
    long, staged, put = sensor(spark), [], cl.stage
    monkeypatch.setattr(cl, "stage", lambda df: (staged.append(put(df)), staged[-1])[1])
    cl.batch_clean(long, config)
    assert staged[0].count() == long.count() and staged[1].count() <= long.count()
    names = ["ph", "water_temp"]
    beside = cl.remove_outliers_beside(cl.mark_strategies(long, names, ["station"]), names, ["station"])
    kept = cl.strategies_without_gaps(long, names)
    columns = ["station", "t_idx", "indicator", "pos", "value"]
    for n, _, z, _ in settings.STRATEGIES:
        mine = cl.of_strategies(beside, ["station"], [n])
        assert {r.strategy for r in mine.select("strategy").distinct().collect()} == {n}
        want = cl.remove_outliers(kept.where(F.col("strategy") == n), names, ["station"], z)
        of = lambda df: sorted(map(str, df.select(*columns).collect()))
        assert of(mine) == of(want)
