"""Graphs, similarity, density and spectra as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import density, graph as gr, impute, scalers as sc, similarity as sim, spectral, split as sp, windows as wn
from chronoloom.operators.skew import spread_if_many
from chronoloom.session import stage
from chronoloom.plans.catalog import (
    IN_LEN, OUT_LEN, PANEL_SQL, RATIO, SAMPLES_SQL, TYPES_SQL, bounds_sql, query, r6, sql_r6, table,
    type_axis, type_panel, user_axis, user_panel, user_samples,
)

# suppliers and parts are the nodes, each line item an edge

NODES_SQL = """nodes AS (SELECT s_suppkey AS node FROM supplier UNION ALL SELECT (SELECT count(*) FROM supplier) + p_partkey FROM part)"""
EDGES_SQL = NODES_SQL + """, edges AS (SELECT l_suppkey AS src, (SELECT count(*) FROM supplier) + l_partkey AS dst, CAST(count(*) AS DOUBLE) AS weight
 FROM lineitem GROUP BY ALL),
sym AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY src, dst)"""


def _nodes(spark, sf_dir):
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    offset = supplier.count()
    nodes = supplier.select(F.col("s_suppkey").alias("node")).union(part.select(F.col("p_partkey") + offset))
    return nodes, offset


def _edges(spark, sf_dir):
    nodes, offset = _nodes(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + offset).alias("dst"))
    edges = spread_if_many(lines, lines.count(), "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return edges, nodes


def _both_ways(edges):
    return gr.undirected(edges)


def _matrix(df, digits=6):
    return df.select("src", "dst", r6("weight", digits).alias("weight"))


@query(f"""WITH ids AS (SELECT 'S' || s_suppkey AS id, s_suppkey AS position FROM supplier
 UNION ALL SELECT 'P' || p_partkey, (SELECT count(*) FROM supplier) + p_partkey FROM part),
raw AS (SELECT a.position AS src, b.position AS dst, l_extendedprice AS distance, (l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS line
 FROM lineitem JOIN ids a ON a.id = 'S' || l_suppkey JOIN ids b ON b.id = 'P' || l_partkey)
SELECT src, dst, {sql_r6('arg_max(distance, line)', 2)} AS distance, CAST(1 AS DOUBLE) AS weight
FROM (SELECT * FROM raw UNION ALL SELECT dst, src, distance, line FROM raw) GROUP BY src, dst""")
def edges_symmetric(spark, sf_dir):
    """GR1, GR2: named ends mapped to positions, both directions, later line wins."""
    supplier, part = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    offset = supplier.count()
    ids = supplier.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"), F.col("s_suppkey").alias("position")).union(
        part.select(F.concat(F.lit("P"), F.col("p_partkey")), F.col("p_partkey") + offset))
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey")).alias("dst"),
        F.col("l_extendedprice").alias("distance"), F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("line"))
    out = gr.symmetric_edges(gr.map_ids(raw, ids))
    return out.select("src", "dst", r6("distance", 2).alias("distance"), "weight")


@query(f"""WITH {EDGES_SQL}, u AS (SELECT * FROM edges UNION ALL SELECT node, node, 1.0 FROM nodes)
SELECT src, dst, sum(weight) AS weight FROM u GROUP BY src, dst""")
def self_loops(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    return gr.with_self_loops(edges, nodes)


def _laplacian(source: str) -> str:
    return f"""deg AS (SELECT src AS node, sum(weight) AS d FROM {source} GROUP BY src HAVING sum(weight) <> 0),
lap AS (SELECT src, dst, sum(weight) AS weight FROM (
 SELECT node AS src, node AS dst, 1.0::DOUBLE AS weight FROM nodes
 UNION ALL SELECT src, dst, -weight / sqrt(a.d) / sqrt(b.d) FROM {source} JOIN deg a ON a.node = src JOIN deg b ON b.node = dst) GROUP BY src, dst)"""


@query(f"WITH {EDGES_SQL}, {_laplacian('sym')} SELECT src, dst, {sql_r6('weight')} AS weight FROM lap")
def sym_laplacian(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    return _matrix(gr.normalized_laplacian(_both_ways(edges), nodes))


@query(f"""WITH {EDGES_SQL}, {_laplacian('sym')}
SELECT src, dst, {sql_r6('sum(weight)')} AS weight FROM (SELECT src, dst, weight FROM lap UNION ALL SELECT node, node, -1.0 FROM nodes) GROUP BY src, dst""")
def scaled_laplacian(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    return _matrix(gr.scaled_laplacian(edges, nodes))


TRADE_SQL = """nodes AS (SELECT n_nationkey AS node FROM nation),
edges AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem
 JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
sym AS (SELECT src, dst, max(weight) AS weight FROM (SELECT * FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY src, dst)"""


def _trade(spark, sf_dir):
    """Nations, and how often customers of one bought from suppliers of another."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = lines.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    lines = lines.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    edges = lines.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return stage(edges), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


def _squared_sql(times: int) -> str:
    """The matrix squared again and again, to trace one: in the end it projects on the largest eigenvector."""
    power = lambda k: f"""sq{k} AS MATERIALIZED (SELECT a.src, b.dst, sum(a.weight * b.weight) AS weight FROM sq{k - 1} a JOIN sq{k - 1} b ON a.dst = b.src GROUP BY ALL),
sn{k} AS MATERIALIZED (SELECT src, dst, weight / (SELECT sum(weight) FROM sq{k} WHERE src = dst) AS weight FROM sq{k})"""  # noqa: E731
    return "sq0 AS (SELECT * FROM lap), " + ", ".join(power(k).replace(f"sq{k - 1} ", f"sn{k - 1} ") if k > 1 else power(k) for k in range(1, times + 1))


@query(f"""WITH {TRADE_SQL}, {_laplacian('sym')}, {_squared_sql(16)},
top AS (SELECT sum(l.weight * p.weight) AS v FROM lap l JOIN sn16 p ON p.src = l.dst AND p.dst = l.src)
SELECT src, dst, {sql_r6('sum(weight)')} AS weight FROM (SELECT src, dst, weight * 2 / v AS weight FROM lap CROSS JOIN top UNION ALL SELECT node, node, -1.0 FROM nodes) GROUP BY src, dst""")
def scaled_laplacian_computed(spark, sf_dir):
    """GR5 with the largest eigenvalue computed; the twin squares the matrix until only that is left."""
    edges, nodes = _trade(spark, sf_dir)
    return _matrix(gr.scaled_laplacian(edges, nodes, None))


@query(f"""WITH {TRADE_SQL}, loops AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM edges UNION ALL SELECT node, node, 1.0 FROM nodes) GROUP BY src, dst),
deg AS (SELECT src AS node, sum(weight) AS d FROM loops GROUP BY src), out_deg AS (SELECT src AS node, sum(weight) AS d FROM edges GROUP BY src),
in_deg AS (SELECT dst AS node, sum(weight) AS d FROM edges GROUP BY dst)
SELECT 'identity' AS kind, 0 AS part, node AS src, node AS dst, 1.0::DOUBLE AS weight FROM nodes
UNION ALL SELECT 'original', 0, src, dst, weight FROM edges
UNION ALL SELECT 'symnadj', 0, dst, src, {sql_r6('weight / d', 12)} FROM loops JOIN deg ON node = src
UNION ALL SELECT 'transition', 0, dst, src, {sql_r6('weight / d', 12)} FROM edges JOIN out_deg ON node = src
UNION ALL SELECT 'doubletransition', 0, dst, src, {sql_r6('weight / d', 12)} FROM edges JOIN out_deg ON node = src
UNION ALL SELECT 'doubletransition', 1, src, dst, {sql_r6('weight / d', 12)} FROM edges JOIN in_deg ON node = dst""")
def adjacency_kinds(spark, sf_dir):
    """GR8: the matrices that a graph model may ask for by name."""
    edges, nodes = _trade(spark, sf_dir)
    parts = [m.select(F.lit(kind).alias("kind"), F.lit(k).alias("part"), "src", "dst", r6("weight", 12).alias("weight"))
             for kind in ("identity", "original", "symnadj", "transition", "doubletransition")
             for k, m in enumerate(gr.load_adjacency(edges, nodes, kind))]
    return sp.union_all(parts)


@query(f"""WITH {EDGES_SQL}, loops AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM edges UNION ALL SELECT node, node, 1.0 FROM nodes) GROUP BY src, dst),
deg AS (SELECT src AS node, sum(weight) AS d FROM loops GROUP BY src)
SELECT dst AS src, src AS dst, {sql_r6('weight / d', 8)} AS weight FROM loops JOIN deg ON node = src""")
def gcn_adjacency(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    return _matrix(gr.message_passing(edges, nodes), 8)


@query(f"""WITH {EDGES_SQL}, deg AS (SELECT src AS node, sum(weight) AS d FROM sym GROUP BY src)
SELECT dst AS src, src AS dst, {sql_r6('weight / d')} AS weight FROM sym JOIN deg ON node = src""")
def transition(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    return _matrix(gr.load_adjacency(_both_ways(edges), nodes, "transition")[0])


@query(f"""WITH {EDGES_SQL}, f AS (SELECT src AS node, sum(weight) AS d FROM edges GROUP BY src), b AS (SELECT dst AS node, sum(weight) AS d FROM edges GROUP BY dst)
SELECT 0 AS matrix, dst AS src, src AS dst, {sql_r6('weight / d')} AS weight FROM edges JOIN f ON node = src
UNION ALL SELECT 1, src, dst, {sql_r6('weight / d')} FROM edges JOIN b ON node = dst""")
def transition_double(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    first, second = gr.load_adjacency(edges, nodes, "doubletransition")
    both = first.withColumn("matrix", F.lit(0)).unionByName(second.withColumn("matrix", F.lit(1)))
    return both.select("matrix", "src", "dst", r6("weight").alias("weight"))


FILLED_TYPES_SQL = TYPES_SQL + """,
filled AS (SELECT node, t_idx, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM types)"""

SCALED_SAMPLES_SQL = FILLED_TYPES_SQL + "," + bounds_sql(source="types_lim") + f""",
fit AS (SELECT node, avg(value) AS m, stddev_pop(value) AS d FROM filled CROSS JOIN types_lim WHERE t_idx < floor(steps * CAST({RATIO[0]} AS DOUBLE)) GROUP BY node),
rows_in AS (SELECT f.node, t_idx - lo AS pos, hi - lo AS len, (value - m) / d AS value FROM filled f JOIN fit ON fit.node = f.node
 JOIN bounds ON split = 'train' AND t_idx >= lo AND t_idx < hi),
members AS (SELECT a.pos AS sample_id, a.node, k.k AS k, b.value FROM rows_in a CROSS JOIN (SELECT unnest(range({IN_LEN + OUT_LEN})) AS k) k
 JOIN rows_in b ON b.node = a.node AND b.pos = a.pos + k.k WHERE a.pos + {IN_LEN + OUT_LEN} <= a.len),
pairs AS (SELECT a.sample_id, a.node, b.node AS other,
 sum(a.value * b.value) FILTER (WHERE a.k < {IN_LEN}) / ((sqrt(sum(a.value * a.value) FILTER (WHERE a.k < {IN_LEN})) + 1e-7) * (sqrt(sum(b.value * b.value) FILTER (WHERE a.k < {IN_LEN})) + 1e-7)) AS past,
 sum(a.value * b.value) FILTER (WHERE a.k >= {IN_LEN}) / ((sqrt(sum(a.value * a.value) FILTER (WHERE a.k >= {IN_LEN})) + 1e-7) * (sqrt(sum(b.value * b.value) FILTER (WHERE a.k >= {IN_LEN})) + 1e-7)) AS future,
 sqrt(sum((a.value - b.value) * (a.value - b.value)) FILTER (WHERE a.k < {IN_LEN})) AS l2, sum(abs(a.value - b.value)) FILTER (WHERE a.k < {IN_LEN}) AS l1
 FROM members a JOIN members b ON a.sample_id = b.sample_id AND a.k = b.k GROUP BY a.sample_id, a.node, b.node)"""


def _scaled_samples(spark, sf_dir):
    """Training windows of the hourly panel, filled and standardised per series."""
    axis = type_axis(spark, sf_dir)
    filled = impute.fill_both_ways(type_panel(spark, sf_dir, axis, staged=True), ["node"], "t_idx", "value")
    stats = sc.zscore_fit(filled, ["node"], "value", sc.train_steps(axis.length, RATIO[0]))
    scaled = sc.zscore_transform(filled, stats, ["node"], "value")
    bounds = sp.split_bounds(axis.length, RATIO, IN_LEN, OUT_LEN)
    rows = sp.one_split(scaled, bounds, "train").withColumn("pos", F.col("t_idx") - bounds["train"][0])
    return wn.sliding_windows(rows, ["node"], "pos", ["value"], IN_LEN, OUT_LEN)


@query(f"WITH {SCALED_SAMPLES_SQL} SELECT sample_id, node, other, {sql_r6('past', 5)} AS value FROM pairs")
def cosine_pairs(spark, sf_dir):
    out = sim.pairwise(_scaled_samples(spark, sf_dir), "inputs", "cosine")
    return out.select("sample_id", "node", "other", r6("value", 5).alias("value"))


@query(f"WITH {SCALED_SAMPLES_SQL} SELECT sample_id, node, other, {sql_r6('l1', 5)} AS l1, {sql_r6('l2', 5)} AS l2 FROM pairs")
def distance_pairs(spark, sf_dir):
    out = sim.pairwise(_scaled_samples(spark, sf_dir), "inputs", ["mae", "mse"])
    return out.select("sample_id", "node", "other", r6("mae", 5).alias("l1"), r6("mse", 5).alias("l2"))


@query(f"""WITH {SCALED_SAMPLES_SQL}
SELECT count(*) AS pairs, count(*) FILTER (WHERE past > 0.9) AS past_similar, count(*) FILTER (WHERE past > 0.9 AND future < 0.4) AS overlap,
 {sql_r6('count(*) FILTER (WHERE past > 0.9 AND future < 0.4) * 1000.0 / count(*)')} AS overlap_ratio,
 {sql_r6('count(*) FILTER (WHERE past > 0.9 AND future < 0.4) * 1000.0 / nullif(count(*) FILTER (WHERE past > 0.9), 0)')} AS indistinguishability FROM pairs""")
def indistinguishability(spark, sf_dir):
    out = sim.indistinguishability(_scaled_samples(spark, sf_dir))
    return out.select("pairs", "past_similar", "overlap", r6("overlap_ratio").alias("overlap_ratio"),
                      r6("indistinguishability").alias("indistinguishability"))


@query(f"""WITH {PANEL_SQL}, {bounds_sql()},
s AS (SELECT split AS label, value FROM panel JOIN bounds ON t_idx >= lo AND t_idx < hi WHERE value IS NOT NULL),
e AS (SELECT min(value) AS a, max(value) AS b, (max(value) - min(value)) / 1000 AS step FROM s),
ks AS (SELECT unnest(range(0, CAST((SELECT ceil(40 / step) FROM e) AS BIGINT))) AS k),
outer_points AS (SELECT k, side, CASE WHEN side = 0 THEN a - k * step ELSE b + k * step END AS x FROM ks CROSS JOIN e CROSS JOIN (VALUES (0), (1)) v(side)),
od AS (SELECT side, k, label, avg(exp(-0.5 * ((x - value) / 5) * ((x - value) / 5))) / (5 * sqrt(2 * pi())) AS d FROM outer_points CROSS JOIN s GROUP BY side, k, label),
cut AS (SELECT side, min(k) AS k FROM (SELECT side, k, max(d) AS d FROM od GROUP BY side, k) WHERE d < 1e-6 GROUP BY side),
ends AS (SELECT a - (SELECT k FROM cut WHERE side = 0) * step AS lo, b + (SELECT k FROM cut WHERE side = 1) * step AS hi FROM e),
grid AS (SELECT i AS point, lo + i * ((hi - lo) / 999) AS x FROM ends CROSS JOIN (SELECT unnest(range(1000)) AS i))
SELECT label, point, {sql_r6('any_value(x)', 5)} AS x, {sql_r6('avg(exp(-0.5 * ((x - value) / 5) * ((x - value) / 5))) / (5 * sqrt(2 * pi()))', 7)} AS density
FROM grid CROSS JOIN s GROUP BY label, point""")
def kde_grid(spark, sf_dir):
    """PR7: how the values of the three splits are distributed."""
    axis = user_axis(spark, sf_dir)
    rows = sp.assign_splits(user_panel(spark, sf_dir, axis, staged=True), sp.split_bounds(axis.length, RATIO, IN_LEN, OUT_LEN))
    out = density.kde_pair(rows, "split", "value")
    return out.select("label", "point", r6("x", 5).alias("x"), r6("density", 7).alias("density"))


@query(f"""WITH {SAMPLES_SQL}, f AS (SELECT unnest(range({IN_LEN})) AS freq),
m AS (SELECT a.split, a.node, a.pos AS sample_id, k.k AS n, coalesce(b.value, 0) AS value FROM rows_in a CROSS JOIN (SELECT unnest(range({IN_LEN})) AS k) k
 JOIN rows_in b ON b.split = a.split AND b.node = a.node AND b.pos = a.pos + k.k WHERE a.pos + {IN_LEN + OUT_LEN} <= a.len)
SELECT split, node, sample_id, freq, {sql_r6(f'sum(value * cos(2 * pi() * freq * n / {IN_LEN}))')} AS re, {sql_r6(f'-sum(value * sin(2 * pi() * freq * n / {IN_LEN}))')} AS im
FROM m CROSS JOIN f GROUP BY split, node, sample_id, freq""")
def dft_window(spark, sf_dir):
    samples = user_samples(spark, sf_dir).withColumn("inputs", F.transform("inputs", lambda x: F.coalesce(x, F.lit(0.0))))
    out = spectral.with_dft(samples, "inputs", IN_LEN)
    pairs = F.arrays_zip("re", "im")
    out = out.select("split", "node", "sample_id", F.posexplode(pairs).alias("freq", "_x"))
    return out.select("split", "node", "sample_id", F.col("freq").cast("long").alias("freq"), r6("_x.re").alias("re"), r6("_x.im").alias("im"))


LONG = 40
LONG_SQL = TYPES_SQL + f""", filled AS (SELECT node, t_idx, coalesce(value, 0) AS value FROM types),
w AS (SELECT a.node, a.t_idx AS sample_id, b.t_idx - a.t_idx AS n, b.value FROM filled a JOIN filled b ON b.node = a.node AND b.t_idx BETWEEN a.t_idx AND a.t_idx + {LONG - 1}
 WHERE a.t_idx + {LONG} <= (SELECT max(t_idx) FROM filled) AND a.t_idx % 8 = 0)"""


def _long_windows(spark, sf_dir):
    rows = type_panel(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(0.0)))
    return wn.sliding_windows(stage(rows), ["node"], "t_idx", ["value"], LONG, 1).where("sample_id % 8 = 0").select("node", "sample_id", "inputs")


@query(f"""WITH {LONG_SQL} SELECT node, sample_id, k, {sql_r6(f'sum(value * cos(2 * pi() * k * n / {LONG}))')} AS re, {sql_r6(f'-sum(value * sin(2 * pi() * k * n / {LONG}))')} AS im
FROM w CROSS JOIN (SELECT unnest(range({LONG})) AS k) GROUP BY node, sample_id, k""")
def dft_long(spark, sf_dir):
    """WIN8 for windows beyond the short path."""
    out = spectral.with_dft(_long_windows(spark, sf_dir), "inputs", LONG)
    rows = out.select("node", "sample_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "_z"))
    return rows.select("node", "sample_id", F.col("k").cast("long").alias("k"), r6("_z.re").alias("re"), r6("_z.im").alias("im"))


@query(f"""WITH {LONG_SQL} SELECT node, sample_id, n AS step, {sql_r6('value')} AS value FROM w""")
def dft_inverse(spark, sf_dir):
    """WIN8 there and back: the window itself."""
    out = spectral.inverse_dft(spectral.with_dft(_long_windows(spark, sf_dir), "inputs", LONG), "re", "im", "back")
    rows = out.select("node", "sample_id", F.posexplode("back").alias("step", "value"))
    return rows.select("node", "sample_id", F.col("step").cast("long").alias("step"), r6("value").alias("value"))
