"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chronoloom.llm.ranks import positions
from chronoloom.session import stage

#: Patterns of membership whose totals may reach the driver; more is an error, not a cut.
MAX_PATTERNS = 100_000


def water_fill(sizes: Mapping, weights: Mapping, total: float, most: float) -> dict:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess goes to the others by weight."""
    target, open_ = {}, set(sizes)
    left = total
    while open_:
        each = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * each > most * sizes[s]}
        for s in full or open_:
            target[s] = float(most * sizes[s]) if full else weights[s] * each
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def min_cost_flow(patterns: Sequence[tuple[Sequence, float]], targets: Mapping, epochs: int) -> list[dict]:
    """Tokens of each pattern for each of its sources.

    The network: a start, one node per pattern with an arc for each pass over
    it (the k-th pass costs 2k-1 a token, so repetition is convex), one node
    per source with its target as capacity, an end.  Shortest augmenting paths
    until none is left; where targets can't be met they are met as far as
    possible.
    """
    p, names = len(patterns), list(targets)
    place = {s: 1 + p + k for k, s in enumerate(names)}
    end = 1 + p + len(names)
    to, cap, cost, out = [], [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, c: float, price: float) -> int:
        for x, y, z, w in ((a, b, c, price), (b, a, 0.0, -price)):
            out[x].append(len(to))
            to.append(y), cap.append(z), cost.append(w)
        return len(to) - 2

    routes = []
    for k, (members, tokens) in enumerate(patterns):
        for e in range(epochs):
            arc(0, 1 + k, float(tokens), 2 * e + 1)
        routes.append({s: arc(1 + k, place[s], float(tokens) * epochs, 0) for s in members})
    for s in names:
        arc(place[s], end, float(targets[s]), 0)
    least = 1e-9 * max([1.0, *targets.values()])
    while True:
        dist, via, queue, waits = {0: 0.0}, {}, [0], {0}
        while queue:
            a = queue.pop(0)
            waits.discard(a)
            for e in out[a]:
                if cap[e] > least and dist[a] + cost[e] < dist.get(to[e], float("inf")) - 1e-12:
                    dist[to[e]], via[to[e]] = dist[a] + cost[e], e
                    if to[e] not in waits:
                        queue.append(to[e])
                        waits.add(to[e])
        if end not in via:
            break
        path, at = [], end
        while at:
            path.append(via[at])
            at = to[via[at] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    return [{s: cap[e ^ 1] for s, e in r.items() if cap[e ^ 1] > least} for r in routes]


def fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents of one piece, in order, as long as they fit into what is left."""
    rows = rows.sort_values("_place")
    left, out = float(rows["_rest"].iloc[0] - rows["_from"].iloc[0]), []
    for size in rows["_size_of"]:
        fits = size <= left
        left -= size * fits
        out.append(fits)
    return rows.assign(_more=out)


def mix(docs: DataFrame, size: str, sources: str, targets: Mapping, key: str = "doc_id", epochs: int = 2,
        seed: int = 0, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """Chooses documents, and how often each is read, so that each source gets its target of tokens.

    ``sources`` is an array of the sources a document belongs to (NULL is a
    source like any other, a document without one is never taken), ``size`` its
    tokens (not NULL).  Documents are counted by pattern of membership; a flow
    sends the tokens of patterns to sources at least cost; a pattern's flow is
    filled with its documents in a seeded order: whole passes first, then
    earlier documents once more, in the last piece those that still fit.  So a
    source misses its target by less than the smallest document left out of
    that piece.

    Returns ``key``, ``size``, ``sources`` as given, ``taken`` (size times
    repeats) and ``routes`` (source and tokens, in the order of passes).  Rows
    equal in key, size and sources are interchangeable; an empty table gives
    an empty one.  ``docs`` is read several times: stage it if it is costly.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(size).alias("_size_of"),
                       F.sort_array(F.array_distinct(F.coalesce(sources, F.array()))).alias("_pattern"),
                       F.col(sources).alias("_given"))
    totals = rows.groupBy("_pattern").agg(F.sum("_size_of").alias("tokens")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of membership")
    patterns = [([s for s in r["_pattern"] if s in targets], float(r["tokens"])) for r in totals]
    flow = min_cost_flow(patterns, targets, epochs)
    plan = []
    for r, (_, tokens), sent in zip(totals, patterns, flow):
        total = sum(sent.values())
        passes = int(total / tokens + 1e-9) if tokens else 0
        at, cuts = 0.0, []
        for s, f in sent.items():
            at += f
            cuts.append((at, s))
        plan.append((r["_pattern"], tokens, passes, max(0.0, total - passes * tokens), cuts))
    shape = rows.schema["_pattern"].dataType.simpleString()
    element = shape[len("array<"):-1]
    table = docs.sparkSession.createDataFrame(
        plan, f"_pattern {shape}, _tokens double, _passes int, _rest double, "
              f"_cuts array<struct<upto:double,source:{element}>>")
    placed = positions(rows, ["_pattern"], ["_key", "_size_of"], measure="_size_of", seed=seed)
    t = F.broadcast(table.withColumnRenamed("_pattern", "_of"))
    placed = placed.join(t, placed["_pattern"].eqNullSafe(t["_of"])).drop("_of")
    split = (F.col("_from") <= F.col("_rest")) & (F.col("_rest") < F.col("_to"))
    whole = placed.filter(~split).withColumn("_more", F.col("_to") <= F.col("_rest"))
    part = placed.filter(split)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)
    at_cut = part.groupBy("_pattern", "_piece").applyInPandas(fill, f"{kinds}, _more boolean")
    chosen = whole.unionByName(at_cut).withColumn("_times", F.col("_passes") + F.col("_more").cast("int"))
    copies = F.when(F.col("_times") > 0, F.sequence(F.lit(0), F.col("_times") - 1)).otherwise(F.array().cast("array<int>"))
    start = lambda e: e * F.col("_tokens") + F.col("_before")
    source = lambda e: F.coalesce(
        F.get(F.filter("_cuts", lambda c: c["upto"] > start(e)), F.lit(0)), F.element_at("_cuts", -1))["source"]
    routes = F.transform(copies, lambda e: F.struct(source(e).alias("source"), F.col("_size_of").alias("tokens")))
    return chosen.select(
        F.col("_key").alias(key), F.col("_size_of").alias(size), F.col("_given").alias(sources),
        (F.col("_size_of") * F.col("_times")).cast("long").alias("taken"), routes.alias("routes"))


def mix_by_source(docs: DataFrame, key: str = "doc_id", source: str = "source", cycle: Sequence[float] = (3, 1, 2),
                  share: float = 1.5, epochs: int = 2, seed: int = 0) -> DataFrame:
    """Mixes documents of one source each; sources weigh ``cycle`` in the order of their names, NULL last.

    ``docs`` has ``size`` (tokens).  Returns ``key``, ``size``,
    ``source_size``, ``target`` and ``taken``.
    """
    rows = stage(docs.select(F.col(key).alias("_id"), "size", F.array(F.col(source).cast("string")).alias("_of")))
    total = {r["s"]: r["n"] for r in rows.groupBy(F.col("_of")[0].alias("s")).agg(F.sum("size").alias("n"))
             .limit(MAX_PATTERNS + 1).collect()}
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weights = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    targets = water_fill(total, weights, share * sum(total.values()), epochs)
    mixed = mix(rows, "size", "_of", targets, key="_id", epochs=epochs, seed=seed)
    table = F.broadcast(docs.sparkSession.createDataFrame(
        [(s, int(total[s]), targets[s]) for s in names], "_source string, source_size long, target double"))
    return mixed.join(table, F.col("_of")[0].eqNullSafe(F.col("_source"))).select(
        F.col("_id").alias(key), F.col("size").cast("long").alias("size"), "source_size", "target", "taken")
