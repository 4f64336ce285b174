import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import arrays, calendar as cal
from chronoloom.operators import panel as pn, split as sp, timeaxis as ta, windows as wn

RATIO = (0.6, 0.2, 0.2)


def ramp(spark, n=100, nodes=1):
    return spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"), F.col("id").alias("t_idx"),
                                 F.col("id").cast("float").alias("value"))


def test_split_lengths():
    plain = sp.split_bounds(100, RATIO, 10, 5)
    assert {k: hi - lo for k, (lo, hi) in plain.items()} == {"train": 60, "valid": 20, "test": 20}
    wide = sp.split_bounds(100, RATIO, 10, 5, overlap=True)
    assert {k: hi - lo for k, (lo, hi) in wide.items()} == {"train": 65, "valid": 34, "test": 29}


def test_overlap_where_a_split_is_too_short():
    bounds = sp.split_bounds(100, (0.8, 0.1, 0.1), 10, 5)
    assert bounds == {"train": (0, 80), "valid": (71, 95), "test": (81, 100)}


@pytest.mark.parametrize("chunk", [15, 16, 40, 1024])
def test_ramp_samples(spark, chunk):
    bounds = sp.split_bounds(100, RATIO, 10, 5)
    rows = sp.assign_splits(ramp(spark, nodes=2), bounds)
    samples = wn.sliding_windows(rows, ["split", "node"], "pos", ["value"], 10, 5, chunk)
    train = samples.where("split = 'train' and node = 1").orderBy("sample_id").collect()
    assert len(train) == sp.sample_count(60, 10, 5) == 46
    assert [r.sample_id for r in train] == list(range(46))
    for r in train:
        assert r.inputs == [float(r.sample_id + k) for k in range(10)]
        assert r.target == [float(r.sample_id + 10 + k) for k in range(5)]
    valid = samples.where("split = 'valid'").agg(F.min(F.col("inputs")[0]), F.max(F.col("target")[4])).first()
    assert tuple(valid) == (60.0, 79.0)


def test_windows_shorter_than_a_sample(spark):
    assert wn.sliding_windows(ramp(spark, 14), ["node"], "t_idx", ["value"], 10, 5).count() == 0


def test_missing_values_stay_in_place(spark):
    rows = ramp(spark, 20).withColumn("value", F.when(F.col("t_idx") != 3, F.col("value")))
    first = wn.sliding_windows(rows, ["node"], "t_idx", ["value"], 4, 2).orderBy("sample_id").first()
    assert first.inputs == [0.0, 1.0, 2.0, None]


@pytest.mark.parametrize("n_buckets", [2, 7, 64])
def test_time_index(spark, n_buckets):
    rng = np.random.default_rng(0)
    seconds = np.concatenate([rng.integers(0, 500, 400), [10**9]])
    df = spark.createDataFrame([(int(s),) for s in seconds], "s long").select(
        cal.from_micros(F.col("s") * 1_000_000).alias("ts"), "s")
    got = ta.time_index(df, "ts", n_buckets=n_buckets).collect()
    expected = {s: i for i, s in enumerate(sorted(set(seconds.tolist())))}
    assert sorted(r.t_idx for r in got) == list(range(len(expected)))
    back = {r.t_idx: r.ts for r in got}
    ordered = [back[i] for i in range(len(back))]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("chunk", [3, 10, 1000, None])
def test_neighbours_and_counts(spark, chunk, monkeypatch):
    monkeypatch.setattr(ta, "CHUNK", 20)
    rng = np.random.default_rng(4)
    data = []
    for s in range(3):
        for t in range(50):
            data.append((s, t, float(t) if rng.random() < 0.15 else None))
    data += [(9, t, None) for t in range(20)]
    df = spark.createDataFrame(data, "series int, t long, v double")
    got = ta.valid_neighbours(df, ["series"], "t", "v", chunk).collect()
    assert len(got) == len(data)
    for r in got:
        known = [t for s, t, v in data if s == r.series and v is not None]
        before, after = [t for t in known if t <= r.t], [t for t in known if t >= r.t]
        assert (r.prev.pos if r.prev else None) == (max(before) if before else None)
        assert (r.next.pos if r.next else None) == (min(after) if after else None)
        assert (r.series_first, r.series_last) == (0, 19 if r.series == 9 else 49)
    counted = ta.running_count(df, ["series"], "t", F.col("v").isNotNull(), "n", chunk).collect()
    for r in counted:
        assert r.n == sum(1 for s, t, v in data if s == r.series and t <= r.t and v is not None)


def test_reindex(spark):
    df = spark.createDataFrame([(0, 5), (0, 9), (0, 70), (1, 3)], "s int, t long")
    got = sorted((r.s, r.t, r.p) for r in ta.reindex(df, ["s"], "t", "p", chunk=8).collect())
    assert got == [(0, 5, 0), (0, 9, 1), (0, 70, 2), (1, 3, 0)]


def test_last_window_and_decoder(spark):
    rows = ramp(spark, 30).withColumn("ts", cal.from_micros(F.col("t_idx") * 60_000_000))
    last = wn.last_window(rows, ["node"], "t_idx", "ts", "value", 4, 2, 60_000_000, 29).first()
    assert last.inputs == [26.0, 27.0, 28.0, 29.0]
    assert [t.minute for t in last.future_ts] == [30, 31]
    samples = wn.sliding_windows(rows, ["node"], "t_idx", ["value"], 4, 2)
    laid = wn.decoder_layout(samples, 4, 2, 3).orderBy("sample_id").first()
    assert laid.x_dec == [1.0, 2.0, 3.0, 0.0, 0.0]
    none = wn.decoder_layout(samples, 4, 2, 0).orderBy("sample_id").first()
    assert none.x_dec == [0.0, 0.0]


def test_patches_and_random_choice(spark):
    samples = wn.sliding_windows(ramp(spark, 40, 2), ["node"], "t_idx", ["value"], 8, 2)
    first = wn.with_patches(samples, "inputs", 8, 4, 2).orderBy("node", "sample_id").first()
    assert first.patches == [[0.0, 1.0, 2.0, 3.0], [2.0, 3.0, 4.0, 5.0], [4.0, 5.0, 6.0, 7.0]]
    a = [(r.node, r.sample_id) for r in wn.random_samples(samples, ["node", "sample_id"], 5, 1).collect()]
    b = [(r.node, r.sample_id) for r in wn.random_samples(samples.repartition(3), ["node", "sample_id"], 5, 1).collect()]
    assert a == b and len(a) == 5
    assert wn.flatten_windows(samples).columns == ["sample_id", "node", "window"]


@pytest.mark.parametrize("subtract_last", [False, True])
def test_instance_norm_round_trip(spark, subtract_last):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 9.0],), ([3.0, 3.0, 3.0, 3.0],)], "w array<double>")
    s = arrays.instance_stats(df, "w", subtract_last)
    s = s.withColumn("n", arrays.instance_norm("w", 1.5, 0.2)).withColumn("b", arrays.instance_denorm("n", 1.5, 0.2))
    for r in s.collect():
        x = np.array(r.w)
        centre = x[-1] if subtract_last else x.mean()
        assert r.n == pytest.approx((x - centre) / np.sqrt(x.var() + 1e-5) * 1.5 + 0.2)
        assert r.b == pytest.approx(r.w, abs=1e-6)


def test_panel_is_dense(spark):
    rows = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 3.0), ("b", "2024-01-01 03:00:00", 5.0)]
    df = spark.createDataFrame(rows, "node string, s string, value double").withColumn("ts", cal.parse_time("s"))
    axis = pn.observed_axis(df, "ts", 3_600_000_000)
    assert axis.length == 4
    got = {(r.node, r.t_idx): r.value for r in pn.to_panel(df, ["node"], "ts", F.col("value"), axis).collect()}
    assert len(got) == 8 and got["a", 0] == 2.0 and got["b", 3] == 5.0 and got["a", 1] is None


def test_slices_and_errors(spark):
    df = ramp(spark, 20, 3)
    assert pn.slice_series(df, [0, 2], 5, 8, 20).count() == 6
    for begin, end in ((-1, 3), (5, 5), (3, 21)):
        with pytest.raises(ValueError):
            pn.slice_series(df, [0], begin, end, 20)
    assert pn.first_steps(df, 4).count() == 12
    assert pn.select_series(df, [1]).count() == 20
    chosen = spark.createDataFrame([(0,), (1,)], "node int")
    assert pn.select_series(df, chosen).count() == 40
    assert pn.match_width(df, ["node"], ["t_idx", "value"], 1).columns == ["node", "t_idx"]
    with pytest.raises(ValueError):
        pn.match_width(df, ["node"], ["value"], 2)
    assert pn.select_features(df, ["node"], ["value"]).columns == ["node", "value"]


def test_hidden_future(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "target array<double>")
    assert pn.hide_future(df).first().target == [None, None]
    assert pn.hide_future(df, training=True).first().target == [1.0, 2.0]


def test_curriculum():
    lengths = [pn.curriculum_length(e, 2, 3, 4, 12) for e in range(1, 13)]
    assert lengths == [12, 12, 4, 4, 4, 8, 8, 8, 12, 12, 12, 12]
    assert pn.curriculum_length(None, 2, 3, 4, 12) == 12


def test_calendar(spark):
    df = spark.createDataFrame([("2024-12-31 18:30:00",)], "s string").withColumn("ts", cal.parse_time("s"))
    r = pn.with_calendar(df).first()
    assert r.tod == pytest.approx(18.5 / 24) and r.dow == pytest.approx(1 / 7)
    assert r.dom == pytest.approx(30 / 31) and r.doy == pytest.approx(365 / 366)
    i = pn.with_index_calendar(spark.createDataFrame([(200,)], "t_idx long"), 24).first()
    assert i.tod == pytest.approx(8 / 24) and i.dow == pytest.approx(1 / 7)
    bad = spark.createDataFrame([("x",)], "s string").select(cal.parse_time("s")).first()
    assert bad[0] is None


def test_frequency(spark):
    def stamps(*minutes):
        return spark.createDataFrame([(i, m) for i, m in enumerate(minutes)], "i int, m long").select(
            "i", cal.from_micros(F.col("m") * 60_000_000).alias("ts"))

    assert pn.infer_frequency_minutes(stamps(0, 5, 10), "ts", "i") == 5
    for bad in ((5, 5), (5, 0), (5,)):
        with pytest.raises(ValueError):
            pn.infer_frequency_minutes(stamps(*bad), "ts", "i")


def test_parameter_grid(spark):
    got = sp.parameter_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).orderBy("combination").collect()
    assert [(r.combination, r.a, r.b) for r in got] == [
        (0, 1, "x"), (1, 1, "y"), (2, 1, "z"), (3, 2, "x"), (4, 2, "y"), (5, 2, "z")]


def test_sets_of_rows(spark):
    df = ramp(spark, 5)
    assert sp.union_all([df, df]).count() == 10
    assert sp.without_rows(df, df.where("t_idx < 2"), ["t_idx"]).count() == 3


def test_windows_by_position(spark):
    """Holes are NULL, chunks without a row too; repeated positions are refused."""
    present = [0, 1, 2, 3, 5, 6, 40, 41, 44]
    df = spark.createDataFrame([("a", p, float(p)) for p in present] + [("a", None, 9.0), ("short", 3, 1.0), (None, 0, 1.0), (None, 2, 3.0), ("b", 7, 7.0), ("b", 9, 9.0), ("b", 10, None)],
                               "node string, pos long, v double")
    for chunk in (1, 4, 1000):
        got = {(r.node, r.sample_id): (r.inputs, r.target) for r in wn.sliding_windows(df, ["node"], "pos", ["v"], 2, 1, chunk=chunk).collect()}
        at = {("a", p): float(p) for p in present} | {("b", 7): 7.0, ("b", 9): 9.0, (None, 0): 1.0, (None, 2): 3.0}
        want = {(n, i): ([at.get((n, i)), at.get((n, i + 1))], [at.get((n, i + 2))])
                for n, lo, hi in (("a", 0, 44), ("b", 7, 10), (None, 0, 2)) for i in range(lo, hi - 1)}
        assert got == want
    assert wn.sliding_windows(df.limit(0), ["node"], "pos", ["v"], 2, 1).count() == 0
    with pytest.raises(Exception, match="same position"):
        wn.sliding_windows(df.union(df), ["node"], "pos", ["v"], 2, 1).count()


def test_last_window_of_ragged_series(spark):
    """Each series ends at its own last value; holes are NULL; a shared end pads those that end early."""
    data = [("a", p, float(p)) for p in range(10)] + [("b", 2, 2.0), ("b", 4, 4.0), ("b", 5, None), ("c", 9, None)]
    df = spark.createDataFrame(data, "node string, pos long, v double").withColumn("ts", cal.from_micros(F.col("pos") * 1_000_000))
    got = {r.node: r for r in wn.last_window(df, ["node"], "pos", "ts", "v", 3, 2, 1_000_000).collect()}
    assert got["a"].inputs == [7.0, 8.0, 9.0] and [t.second for t in got["a"].future_ts] == [10, 11]
    assert got["b"].inputs == [2.0, None, 4.0] and [t.second for t in got["b"].future_ts] == [5, 6]
    assert "c" not in got
    shared = {r.node: r for r in wn.last_window(df, ["node"], "pos", "ts", "v", 6, 1, 1_000_000, last_pos=9).collect()}
    assert shared["b"].inputs == [4.0, None, None, None, None, None] and shared["b"].future_ts[0].second == 10


def test_buckets_beyond_the_splitters(spark, monkeypatch):
    """More buckets than splitters: still in order, still balanced, and ordinals stay gapless."""
    monkeypatch.setattr(ta, "SPLITTERS", 4)
    df = spark.range(4000).select(F.col("id"), (F.col("id") * F.col("id")).alias("pos"))
    rows = ta.balanced_buckets(df, "pos", 64).orderBy("pos").collect()
    buckets = [r._bucket for r in rows]
    assert buckets == sorted(buckets) and len(set(buckets)) > 30
    assert max(np.bincount(np.array(buckets, int))) < 400
    times = df.select(cal.from_micros(F.col("pos") * 1000).alias("ts"))
    got = ta.time_index(times, "ts", n_buckets=64).orderBy("ts").collect()
    assert [r.t_idx for r in got] == list(range(4000))
    monkeypatch.setattr(ta, "CHUNK", 50)
    counted = ta.running_count(df.withColumn("k", F.lit("a")), ["k"], "pos", F.lit(True), "n", None).orderBy("pos").collect()
    assert [r.n for r in counted] == list(range(1, 4001))


def test_panel_is_dealt_before_it_is_unfolded(spark):
    """Only observed cells are exchanged, not the rows that fill the axis."""
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 7, 3.0), ("a", 7, 5.0), ("b", 3, None), (None, 2, 4.0)], "node string, at long, value double")
    df = df.withColumn("ts", cal.from_micros(F.col("at") * 1_000_000)).unionByName(df.withColumn("ts", F.lit(None).cast("timestamp_ntz")).where("at = 3"))
    out = pn.to_panel(df, ["node"], "ts", F.col("value"), pn.Axis(0, 1_000_000, 8))
    got = {(r.node, r.t_idx): r.value for r in out.collect()}
    want = {(n, t): None for n in ("a", "b", None) for t in range(8)} | {("a", 0): 1.0, ("a", 7): 4.0, (None, 2): 4.0, ("b", None): None}
    assert got == want and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate")[0]
