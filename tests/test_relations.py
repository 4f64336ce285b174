import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import density, graph as gr, similarity as sim, spectral

RNG = np.random.default_rng(31)


def edges_of(spark, a):
    return spark.createDataFrame(
        [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src int, dst int, weight double")


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.src, r.dst] += r.weight
    return out


@pytest.fixture(scope="module")
def adjacency(spark):
    a = RNG.uniform(0.1, 2, (6, 6)) * (RNG.random((6, 6)) < 0.5)
    a[5, :] = a[:, 5] = 0
    a[0, 1] = 1.0
    nodes = spark.range(6).select(F.col("id").cast("int").alias("node"))
    return a, edges_of(spark, a), nodes


def by_hand(a, power):
    d = a.sum(1)
    with np.errstate(divide="ignore"):
        f = np.where(d != 0, d**power, 0.0)
    return f


def test_transforms(adjacency):
    a, edges, nodes = adjacency
    f = by_hand(a, -0.5)
    lap = np.eye(6) - f[:, None] * a * f[None, :]
    np.testing.assert_allclose(dense(gr.normalized_laplacian(edges, nodes), 6), lap, atol=1e-12)
    u = np.maximum(a, a.T)
    np.testing.assert_allclose(dense(gr.undirected(edges), 6), u, atol=1e-12)
    fu = by_hand(u, -0.5)
    lap_u = np.eye(6) - fu[:, None] * u * fu[None, :]
    np.testing.assert_allclose(dense(gr.load_adjacency(edges, nodes, "scalap")[0], 6), lap_u - np.eye(6), atol=1e-12)
    loops = a + np.eye(6)
    g = by_hand(loops, -0.5)
    np.testing.assert_allclose(dense(gr.load_adjacency(edges, nodes, "symnadj")[0], 6), (g[:, None] * loops).T * g[None, :], atol=1e-12)
    p = by_hand(a, -1.0)[:, None] * a
    np.testing.assert_allclose(dense(gr.load_adjacency(edges, nodes, "transition")[0], 6), p.T, atol=1e-12)
    first, second = gr.load_adjacency(edges, nodes, "doubletransition")
    np.testing.assert_allclose(dense(first, 6), p.T, atol=1e-12)
    np.testing.assert_allclose(dense(second, 6), (by_hand(a.T, -1.0)[:, None] * a.T).T, atol=1e-12)
    np.testing.assert_allclose(dense(gr.load_adjacency(edges, nodes, "identity")[0], 6), np.eye(6))
    np.testing.assert_allclose(dense(gr.load_adjacency(edges, nodes, "original")[0], 6), a)
    np.testing.assert_allclose(dense(gr.with_self_loops(edges, nodes), 6), loops)
    assert gr.nodes_of(edges).count() == len(np.flatnonzero((a.sum(0) + a.sum(1)) > 0))
    with pytest.raises(ValueError):
        gr.load_adjacency(edges, nodes, "nope")


def test_computed_eigenvalue(adjacency):
    a, edges, nodes = adjacency
    u = np.maximum(a, a.T)
    f = by_hand(u, -0.5)
    lap = np.eye(6) - f[:, None] * u * f[None, :]
    top = np.linalg.eigvalsh(lap).max()
    got = dense(gr.scaled_laplacian(edges, nodes, lambda_max=None), 6)
    np.testing.assert_allclose(got, 2 / top * lap - np.eye(6), atol=1e-4)


def test_symmetric_edges(spark):
    ids = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "id long, position long")
    raw = spark.createDataFrame(
        [(10, 20, 1.5, 0), (20, 10, 2.5, 1), (30, 10, 4.0, 2), (99, 10, 9.0, 3)], "src long, dst long, distance double, line long")
    got = {(r.src, r.dst): (r.weight, r.distance) for r in gr.symmetric_edges(gr.map_ids(raw, ids)).collect()}
    assert got == {(0, 1): (1.0, 2.5), (1, 0): (1.0, 2.5), (2, 0): (1.0, 4.0), (0, 2): (1.0, 4.0)}


@pytest.fixture(scope="module")
def windows(spark):
    x, y = RNG.normal(0, 1, (4, 7, 5)), RNG.normal(0, 1, (4, 7, 3))
    x[:, 1] = x[:, 0] * 1.01
    x[2, 3] = 0.0
    data = [(s, n, x[s, n].tolist(), y[s, n].tolist()) for s in range(4) for n in range(7)]
    return x, y, spark.createDataFrame(data, "sample_id int, node int, inputs array<double>, target array<double>")


def cosine(x):
    norm = np.linalg.norm(x, axis=2) + 1e-7
    return np.einsum("snl,sml->snm", x, x) / (norm[:, :, None] * norm[:, None, :])


@pytest.mark.parametrize("block", [2, 256])
def test_similarity(windows, block):
    x, _, df = windows
    wanted = {
        "cosine": cosine(x), "mse": np.sqrt(((x[:, :, None] - x[:, None]) ** 2).sum(3)), "mae": np.abs(x[:, :, None] - x[:, None]).sum(3)}
    for metric, expected in wanted.items():
        got = np.zeros((4, 7, 7))
        rows = sim.pairwise(df, "inputs", metric, block=block).collect()
        assert len(rows) == 4 * 49
        for r in rows:
            got[r.sample_id, r.node, r.other] = r.value
        np.testing.assert_allclose(got, expected, atol=1e-9)
    with pytest.raises(NotImplementedError):
        sim.pairwise(df, "inputs", "nope")


def test_blocks_of_a_window_meet_by_pair(spark, windows):
    """One pass for several measures; rows are never dealt out by the window alone."""
    x, y, df = windows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = sim.pairwise(df, "inputs", ["mae", "mse"], block=2)
        plan = out._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert dealt and all("_i" in d and "_j" in d for d in dealt)
        assert plan.count("MapInPandas") == 1
        got = {(r.sample_id, r.node, r.other): (r.mae, r.mse) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == 4 * 49
    for metric, k in (("mae", 0), ("mse", 1)):
        for r in sim.pairwise(df, "inputs", metric).collect():
            assert got[r.sample_id, r.node, r.other][k] == pytest.approx(r.value)


@pytest.mark.parametrize("block", [2, 256])
def test_indistinguishability(windows, block):
    x, y, df = windows
    past, future = cosine(x) > 0.9, cosine(y) < 0.4
    r = sim.indistinguishability(df, block=block).first()
    assert (r.pairs, r.past_similar, r.overlap) == (4 * 49, past.sum(), (past & future).sum())
    assert r.overlap_ratio == pytest.approx((past & future).sum() / past.size * 1000)
    assert r.indistinguishability == pytest.approx((past & future).sum() / past.sum() * 1000)


def kde(v, x, h):
    return np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("scale", [40.0, 0.01])
def test_density(spark, scale):
    a, b = RNG.normal(0, scale, 200), RNG.normal(scale, scale / 2, 300)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("b", None)], "g string, v double")
    out = density.kde_pair(df, "g", "v", bandwidth=5.0).toPandas()
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    step = (hi - lo) / 1000
    low, high = 0, 0
    edge = lambda t: max(kde(a, np.array([t]), 5.0)[0], kde(b, np.array([t]), 5.0)[0])
    reach = 30 / step
    while edge(lo - low * step) >= 1e-6:
        low += max(1, int(reach / 200_000))
    while edge(hi + high * step) >= 1e-6:
        high += max(1, int(reach / 200_000))
    x = np.linspace(lo - low * step, hi + high * step, 1000)
    for g, v in (("a", a), ("b", b)):
        part = out[out.label == g].sort_values("point")
        np.testing.assert_allclose(part.x, x, atol=scale * 0.01 + 1e-9)
        np.testing.assert_allclose(part.density, kde(v, part.x.to_numpy(), 5.0), atol=1e-12)


@pytest.mark.parametrize("length", [6, 40])
def test_fourier_round_trip(spark, length):
    x = RNG.normal(0, 1, (5, length))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "i int, w array<double>")
    out = spectral.inverse_dft(spectral.with_dft(df, "w", length), "re", "im", "back").orderBy("i").collect()
    for i, r in enumerate(out):
        f = np.fft.fft(x[i])
        np.testing.assert_allclose(r.re, f.real, atol=1e-9)
        np.testing.assert_allclose(r.im, f.imag, atol=1e-9)
        np.testing.assert_allclose(r.back, x[i], atol=1e-9)


def test_density_leaves_out_what_is_not_finite(spark):
    good = [("a", 1.0), ("a", 4.0), ("b", 2.0)]
    odd = [("a", float("nan")), ("b", float("inf")), ("b", float("-inf")), ("a", None)]
    made = [density.kde_pair(spark.createDataFrame(r, "g string, v double"), "g", "v").orderBy("label", "point").toPandas()
            for r in (good, good + odd)]
    np.testing.assert_allclose(made[0][["x", "density"]].to_numpy(float), made[1][["x", "density"]].to_numpy(float))
    assert density.kde_pair(spark.createDataFrame(odd, "g string, v double"), "g", "v").count() == 0


def test_eigenvalue_converges_or_raises(spark):
    """A path's eigenvalues lie close together; too few products are an error, never a guess."""
    n = 60
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "src int, dst int, weight double")
    full = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    assert abs(gr.largest_eigenvalue(edges, tol=1e-9)) == pytest.approx(np.abs(np.linalg.eigvalsh(full)).max(), rel=1e-7)  # of either sign
    with pytest.raises(ArithmeticError):
        gr.largest_eigenvalue(edges, rounds=3)
    assert gr.largest_eigenvalue(edges.limit(0)) == 0.0


@pytest.mark.parametrize("length", [4, 40])
def test_transform_of_windows_with_missing_values(spark, length):
    """Short and long windows agree: one missing value makes the whole spectrum missing."""
    rows = [(0, [float(k % 5) for k in range(length)]), (1, [None] + [1.0] * (length - 1)), (2, [1.0] * (length - 1) + [None])]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    got = {r.k: r for r in spectral.with_dft(df, "x", length).collect()}
    assert np.allclose(got[0].re, np.fft.fft(rows[0][1]).real) and len(got[1].re) == length
    assert set(got[1].re) == set(got[2].im) == {None}
    back = {r.k: r.y for r in spectral.inverse_dft(spectral.with_dft(df, "x", length), "re", "im", "y").collect()}
    assert np.allclose(back[0], rows[0][1]) and set(back[1]) == {None}


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """What meets in a task does not grow with the graph; hubs are salted, and the matrices stay the same."""
    from chronoloom.operators import skew

    rows = [(0, d, 1.0 + d) for d in range(1, 60)] + [(s, (s * 7) % 60, 2.0) for s in range(1, 60)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    nodes = spark.range(60).select(F.col("id").alias("node"))
    made = lambda: [dense(m, 60) for m in (
        gr.load_adjacency(gr.undirected(edges), nodes, "transition")[0], gr.scaled_laplacian(edges, nodes), gr.normalized_laplacian(edges, nodes))]
    want = made()
    monkeypatch.setattr(skew, "TASK", 10)
    monkeypatch.setattr(skew.join_one, "__defaults__", (5, "inner", None))
    assert gr.undirected(edges).rdd.getNumPartitions() >= len(rows) * 2 // 10
    for a, b in zip(made(), want):
        np.testing.assert_allclose(a, b, atol=1e-12)


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    from chronoloom.sources import tables

    for k, n in enumerate((3000, 1, 500)):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{k},{i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        out = tables.file_lines(spark, str(tmp_path))
        assert "hashpartitioning" not in out.select("line")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
        got = [r.value for r in out.orderBy("line").collect()]
        assert [r.line for r in out.select("line").orderBy("line").collect()] == list(range(3501))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [f"{k},{i}" for k, n in enumerate((3000, 1, 500)) for i in range(n)]
