"""Adjacency matrices as edge tables ``(src, dst, weight)`` (GR1-GR8).

A matrix is the set of its non-zero entries.  Degrees are one aggregation;
products with a diagonal are joins on one end of the edge, where a hub is
salted.  Edges are dealt over as many tasks as their number asks for, so what a
task holds does not grow with the graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chronoloom.operators.skew import join_one, spread
from chronoloom.session import cut_lineage, stage


def map_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """GR1: external ids to positions; ``ids`` is ``(id, position)``. Unknown ends drop out."""
    edges, rest = stage(edges), [c for c in edges.columns if c not in ("src", "dst")]

    def at(end: str, name: str) -> DataFrame:
        """The position of each id found at one end, and how many edges have it there."""
        count = edges.groupBy(end).agg(F.count(F.lit(1)).alias("_edges"))
        return stage(ids.select(F.col("id").alias(end), F.col("position").alias(name)).join(count, end))

    out = join_one(edges, at("src", "_s"), ["src"], "_edges").drop("_edges")
    out = join_one(stage(out), at("dst", "_d"), ["dst"], "_edges")
    return out.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest)


def symmetric_edges(edges: DataFrame, line: str = "line") -> DataFrame:
    """GR2: both directions of each edge; on duplicates the later line wins.

    ``edges`` is ``(src, dst, distance, line)``.  The result carries the
    connectivity (1) and the distance.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance", line)
    both = stage(edges.select("src", "dst", "distance", line).unionByName(back))
    return spread(both, both.count(), "src", "dst").groupBy("src", "dst").agg(F.max_by("distance", line).alias("distance")).withColumn(
        "weight", F.lit(1.0))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def identity(nodes: DataFrame) -> DataFrame:
    """GR8."""
    return nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("weight"))


def add(*matrices: DataFrame) -> DataFrame:
    out = matrices[0].select("src", "dst", "weight")
    for m in matrices[1:]:
        out = out.unionByName(m.select("src", "dst", "weight"))
    out = stage(out)
    return spread(out, out.count(), "src", "dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR3."""
    return add(edges, identity(nodes))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def row_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))


def _scaled(edges: DataFrame, power: float, both_ends: bool) -> DataFrame:
    """D^p A, or D^p A D^p; a zero degree stays zero, and its edges drop out."""
    edges = stage(edges.select("src", "dst", "weight"))

    def at(end: str, name: str) -> DataFrame:
        """The factor of each node at one end, and how many edges have it there."""
        count = edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias("_edges"))
        return stage(count.join(factor, "node").select(F.col("node").alias(end), F.col("factor").alias(name), "_edges"))

    factor = row_degrees(edges).where(F.col("degree") != 0).select(
        "node", F.pow("degree", F.lit(power)).alias("factor"))
    if both_ends:
        factor = stage(factor)
    out = join_one(edges, at("src", "_f"), ["src"], "_edges").drop("_edges")
    if both_ends:
        out = join_one(stage(out), at("dst", "_g"), ["dst"], "_edges")
        return out.select("src", "dst", (F.col("_f") * F.col("weight") * F.col("_g")).alias("weight"))
    return out.select("src", "dst", (F.col("_f") * F.col("weight")).alias("weight"))


def normalized_laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR4."""
    scaled = _scaled(edges, -0.5, True)
    return add(identity(nodes), scaled.withColumn("weight", -F.col("weight")))


def undirected(edges: DataFrame) -> DataFrame:
    """The larger of the two directions; an absent entry is zero."""
    both = edges.select("src", "dst", "weight", F.lit(1).alias("side")).unionByName(
        transpose(edges).withColumn("side", F.lit(2)))
    both = stage(both)
    pair = spread(both, both.count(), "src", "dst").groupBy("src", "dst").agg(
        F.coalesce(F.max(F.when(F.col("side") == 1, F.col("weight"))), F.lit(0.0)).alias("_a"),
        F.coalesce(F.max(F.when(F.col("side") == 2, F.col("weight"))), F.lit(0.0)).alias("_b"))
    return pair.select("src", "dst", F.greatest("_a", "_b").alias("weight")).where(F.col("weight") != 0)


def scaled_laplacian(edges: DataFrame, nodes: DataFrame, lambda_max: float | None = 2.0, directed: bool = False) -> DataFrame:
    """GR5: (2 / lambda) L - I; without a given lambda the largest eigenvalue is computed."""
    lap = normalized_laplacian(edges if directed else undirected(edges), nodes)
    if lambda_max is None:
        lambda_max = largest_eigenvalue(lap)
    stretched = lap.withColumn("weight", F.col("weight") * F.lit(2.0 / lambda_max))
    return add(stretched, identity(nodes).withColumn("weight", F.lit(-1.0)))


def largest_eigenvalue(matrix: DataFrame, rounds: int = 300, tol: float = 1e-10) -> float:
    """The eigenvalue of largest size of a symmetric matrix, by Lanczos' method.

    Each round is one product with the matrix, so one join and one aggregation;
    two vectors are kept, whose lineage is cut, and two sums reach the driver.
    The eigenvalue is taken when its residual is within ``tol`` of its size; if
    that is not so after ``rounds`` products, an error is raised.  The driver
    solves a tridiagonal matrix of one row per round.
    """
    matrix = cut_lineage(matrix.select("src", "dst", "weight"))
    start = (F.pmod(F.xxhash64("node"), F.lit(1000)) + 1).cast("double")
    vector = matrix.select(F.col("src").alias("node")).union(matrix.select("dst")).distinct().select(
        "node", start.alias("x"), F.lit(0.0).alias("before"))
    vector = cut_lineage(vector)
    norm = vector.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
    if not norm:
        return 0.0
    vector = vector.withColumn("x", F.col("x") / F.lit(norm))
    diagonal, beside, beta = [], [], 0.0
    for _ in range(rounds):
        image = matrix.join(vector.select(F.col("node").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("node")).agg(
            F.sum(F.col("weight") * F.col("x")).alias("y"))
        both = cut_lineage(vector.join(image, "node", "left").withColumn("y", F.coalesce("y", F.lit(0.0))))
        alpha = both.agg(F.sum(F.col("x") * F.col("y"))).first()[0]
        rest = F.col("y") - F.lit(alpha) * F.col("x") - F.lit(beta) * F.col("before")
        diagonal.append(alpha)
        beta = both.agg(F.sqrt(F.sum(rest * rest))).first()[0]
        values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
        best = int(np.argmax(np.abs(values)))
        if beta * abs(vectors[-1, best]) <= tol * max(abs(values[best]), 1e-300):
            return float(values[best])
        beside.append(beta)
        vector = both.select("node", (rest / F.lit(beta)).alias("x"), F.col("x").alias("before"))
    raise ArithmeticError(f"no eigenvalue within {tol} after {rounds} products, the last had residual {beta * abs(vectors[-1, best])}")


def message_passing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR6: the renormalised adjacency with self loops, (D^-1/2 (A + I))^T D^-1/2.

    Both factors fall on the row of the untransposed matrix, so an entry is
    divided by its whole row sum, also where the matrix is not symmetric.
    """
    return transpose(_scaled(with_self_loops(edges, nodes), -1.0, False))


def transition(edges: DataFrame) -> DataFrame:
    """GR7: rows that sum to one."""
    return _scaled(edges, -1.0, False)


def load_adjacency(edges: DataFrame, nodes: DataFrame, kind: str) -> list[DataFrame]:
    """GR8: the list of matrices a graph model takes, by name of the transform."""
    if kind == "scalap":
        return [scaled_laplacian(edges, nodes)]
    if kind == "normlap":
        return [normalized_laplacian(edges, nodes)]
    if kind == "symnadj":
        return [message_passing(edges, nodes)]
    if kind == "transition":
        return [transpose(transition(edges))]
    if kind == "doubletransition":
        return [transpose(transition(edges)), transpose(transition(transpose(edges)))]
    if kind == "identity":
        return [identity(nodes)]
    if kind == "original":
        return [edges.select("src", "dst", "weight")]
    raise ValueError(f"unknown adjacency type {kind}")
