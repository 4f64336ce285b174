"""Cubic spline interpolation of long series (IMP3).

A not-a-knot spline couples all knots of a series by one tridiagonal system.  It
is solved in parts: knots are cut into blocks along the axis, each with the knot
before and the knot after it.  A block expresses its curvatures by those of its
two neighbours, of which only what concerns its first and last knot leaves the
task; these interface rows, one per block, are solved per series, and each block
substitutes the curvatures next to it back.  The result is that of the whole
system.  Blocks of a batch are solved together by cyclic reduction, in a number
of array operations that grows with the logarithm of a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from chronoloom.operators.timeaxis import in_chunks, valid_neighbours
from chronoloom.session import stage

#: Positions of a block.
BLOCK = 16_384
#: A coupling this small against the diagonal is below the precision of a double.
FADED = 1e-30


def tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves diagonally dominant systems by cyclic reduction; ``rhs`` has a column per right-hand side.

    Systems may stand one behind the other: where ``low`` or ``up`` is zero
    nothing is coupled.
    """
    def moved(a: np.ndarray, by: int, fill: float) -> np.ndarray:
        out = np.full_like(a, fill)
        if by > 0:
            out[by:] = a[:-by]
        else:
            out[:by] = a[-by:]
        return out

    step, n = 1, len(mid)
    while step < n and (np.maximum(np.abs(low), np.abs(up)) > FADED * np.abs(mid)).any():
        a, c = -low / moved(mid, step, 1.0), -up / moved(mid, -step, 1.0)
        rhs = rhs + a[:, None] * moved(rhs, step, 0.0) + c[:, None] * moved(rhs, -step, 0.0)
        mid, low, up = (mid + a * moved(up, step, 0.0) + c * moved(low, -step, 0.0), a * moved(low, step, 0.0),
                        c * moved(up, -step, 0.0))
        step *= 2
    return rhs / mid[:, None]


class Blocks:
    """Blocks of one batch as arrays one behind the other.

    Each block holds its knots and, but for the ends of a series, one knot of
    each neighbour.  Unknown are the curvatures of all but the outer two.
    """

    def __init__(self, xs: list[np.ndarray], ys: list[np.ndarray], left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.size = np.array([len(x) for x in xs])
        self.start = np.cumsum(self.size) - self.size
        # each block has a scale of its own: microseconds squared would lose digits
        self.unit = np.array([(x[-1] - x[0]) / max(len(x) - 1, 1) or 1.0 for x in xs])
        x = np.concatenate([(x - x[0]) / u for x, u in zip(xs, self.unit)])
        y = np.concatenate(ys)
        h = np.append(np.diff(x), 1.0)
        inner = np.ones(len(x), bool)
        inner[self.start] = inner[self.start + self.size - 1] = False
        last = np.zeros(len(x), bool)
        last[self.start + self.size - 1] = True
        wrong = (h <= 0) & ~last
        self.bad = np.logical_or.reduceat(wrong, self.start)  # repeated positions: no spline
        h = np.where(wrong | last, 1.0, h)
        slope = np.append(np.diff(y), 0.0) / h
        self.h, self.at = h, np.flatnonzero(inner)
        k = self.at
        self.low, self.up = h[k - 1].copy(), h[k].copy()
        self.mid = 2.0 * (self.low + self.up)
        self.rhs = 6.0 * (slope[k] - slope[k - 1])
        self.rows = self.size - 2
        self.first = np.cumsum(self.rows) - self.rows
        self.last = self.first + self.rows - 1
        # an end condition expresses the outer curvature through the two next to it
        for side, sign in ((left, 1), (right, -1)):
            b = np.flatnonzero(side)
            row = self.first[b] if sign == 1 else self.last[b]
            outer = h[self.start[b]] if sign == 1 else h[self.start[b] + self.size[b] - 2]
            inside = h[self.start[b] + 1] if sign == 1 else h[self.start[b] + self.size[b] - 3]
            q = outer / inside
            self.mid[row] += outer * (1.0 + q)
            (self.up if sign == 1 else self.low)[row] -= outer * q
        self.to_prev = np.where(left, 0.0, self.low[self.first])
        self.to_next = np.where(right, 0.0, self.up[self.last])
        self.low[self.first] = 0.0
        self.up[self.last] = 0.0

    def eliminated(self) -> np.ndarray:
        """Per block: first and last unknown as u - v * previous - w * next; columns u1 v1 w1 un vn wn."""
        rhs = np.zeros((len(self.mid), 3))
        rhs[:, 0] = self.rhs
        rhs[self.first, 1] = self.to_prev
        rhs[self.last, 2] = self.to_next
        m = tridiagonal(self.low, self.mid, self.up, rhs)
        out = np.hstack([m[self.first], m[self.last]])
        out[:, [0, 3]] /= self.unit[:, None] ** 2
        out[self.bad] = np.nan
        return out

    def solved(self, prev: np.ndarray, next_: np.ndarray) -> list[np.ndarray]:
        """Curvatures of all knots of each block, its neighbours' included; those before and after it are given."""
        prev, next_ = (np.nan_to_num(v) * self.unit ** 2 for v in (prev, next_))
        rhs = self.rhs.copy()
        np.subtract.at(rhs, self.first, self.to_prev * prev)
        np.subtract.at(rhs, self.last, self.to_next * next_)
        m = np.zeros(self.size.sum())
        m[self.at] = tridiagonal(self.low, self.mid, self.up, rhs[:, None])[:, 0]
        head, tail = self.start, self.start + self.size - 1
        m[head], m[tail] = prev, next_
        for side, outer, sign in ((self.left, head, 1), (self.right, tail, -1)):
            o = outer[side]
            q = self.h[o if sign == 1 else o - 1] / self.h[o + 1 if sign == 1 else o - 2]
            m[o] = (1.0 + q) * m[o + sign] - q * m[o + 2 * sign]
        m /= np.repeat(self.unit ** 2, self.size)
        m[np.repeat(self.bad, self.size)] = np.nan
        return np.split(m, self.start[1:])


def curvatures(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of one whole series of four knots or more."""
    ends = np.ones(1, bool)
    return Blocks([np.asarray(x, float)], [np.asarray(y, float)], ends, ends).solved(np.zeros(1), np.zeros(1))[0]


def interface(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Curvatures before and after each block of a series, in order of blocks, from what they eliminated."""
    u1, v1, w1, un, vn, wn = (rows[c].tolist() for c in ("u1", "v1", "w1", "un", "vn", "wn"))
    n = len(u1)
    # the last unknown of the block before is p - q times the first of this one
    p, q = 0.0, 0.0
    kept = []
    for k in range(n):
        d = 1.0 - v1[k] * q
        base, to_next = (u1[k] - v1[k] * p) / d, w1[k] / d
        kept.append((p, q, base, to_next))
        p, q = un[k] - vn[k] * (p - q * base), wn[k] + vn[k] * q * to_next
    prev, next_, first = [0.0] * n, [0.0] * n, 0.0
    for k in range(n - 1, -1, -1):
        before, slope, base, to_next = kept[k]
        next_[k] = first
        first = base - to_next * first
        prev[k] = before - slope * first
    return np.array(prev), np.array(next_)


def packed_blocks(rows: DataFrame, keys: Sequence[str], pos: str, axis: str, value: str, totals: DataFrame, block: int | None) -> DataFrame:
    """(keys, _block, _at, _own, _x, _y): the knots of each block in order, with one knot of each neighbour.

    A block of a single knot at an end of a series joins the next one, as an end
    condition needs two knots of its own.
    """
    valid = rows.where(F.col(value).isNotNull()).select(
        *keys, F.col(pos).alias("_at"), F.col(axis).cast("double").alias("_x"), F.col(value).cast("double").alias("_y"))
    knots = in_chunks(valid, "_at", block)
    point = lambda pick: F.struct(pick("_at").alias("_at"), *[
        (F.min_by if pick is F.min else F.max_by)(c, "_at").alias(c) for c in ("_x", "_y")])
    ends = knots.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"), point(F.min).alias("_head"), point(F.max).alias("_tail"))
    ends = ends.join(totals, list(keys), "left_semi")
    along = Window.partitionBy(*keys).orderBy("_chunk")
    before, after = F.lag("_chunk").over(along), F.lead("_chunk").over(along)
    lone = F.col("_n") == 1
    mapped = stage(ends.withColumn(
        "_block", F.when(lone & before.isNull() & after.isNotNull(), after).when(lone & after.isNull() & before.isNotNull(), before)
        .otherwise(F.col("_chunk"))))
    whole = mapped.groupBy(*keys, "_block").agg(F.min("_head").alias("_head"), F.max("_tail").alias("_tail"))
    line = Window.partitionBy(*keys).orderBy("_block")
    beside = whole.withColumns({"_before": F.lag("_block").over(line), "_after": F.lead("_block").over(line)})
    near = beside.select(*keys, F.explode(F.array(
        F.struct(F.col("_before").alias("_block"), F.col("_head").alias("_p")),
        F.struct(F.col("_after").alias("_block"), F.col("_tail").alias("_p")))).alias("_h"))
    halo = near.where(F.col("_h._block").isNotNull()).select(*keys, "_h._block", F.lit(False).alias("_own"), "_h._p.*")
    own = knots.join(mapped.select(*keys, "_chunk", "_block"), [*keys, "_chunk"]).select(
        *keys, "_block", F.lit(True).alias("_own"), "_at", "_x", "_y")
    listed = own.unionByName(halo).groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_own", "_x", "_y"))).alias("_list"))
    return listed.select(*keys, "_block", *[F.col(f"_list.{c}").alias(c) for c in ("_at", "_own", "_x", "_y")])


def _batch(part: pd.DataFrame) -> Blocks:
    left = np.array([o[0] for o in part["_own"]], bool)
    right = np.array([o[-1] for o in part["_own"]], bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        return Blocks(part["_x"].tolist(), part["_y"].tolist(), left, right)


def _parts(batches: Iterator[pd.DataFrame], knots: int = 1 << 18) -> Iterator[pd.DataFrame]:
    """Batches cut to a bounded number of knots."""
    for batch in batches:
        if len(batch):
            group = np.cumsum(batch["_x"].map(len).to_numpy()) // knots
            for _, part in batch.groupby(group, sort=False):
                yield part


def spline_curvatures(
    rows: DataFrame, keys: Sequence[str], pos: str, axis: str, value: str, totals: DataFrame | None = None,
    block: int | None = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(keys, _at, _m): the curvature at every knot; (keys, _left, _right): the cubics at both ends, x0 y0 m0 x1 y1 m1.

    ``totals`` names the series to cover (keys); without it every series with
    four or more values.  Series with repeated positions get NaN.
    """
    keys = list(keys)
    if totals is None:
        totals = rows.groupBy(*keys).agg(F.count(value).alias("_total")).where(F.col("_total") >= 4)
    packed = stage(packed_blocks(rows, keys, pos, axis, value, totals.select(*keys), block))
    types = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    named = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "_block"])
    shares = ["u1", "v1", "w1", "un", "vn", "wn"]

    def eliminate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            yield part[[*keys, "_block"]].reset_index(drop=True).join(pd.DataFrame(_batch(part).eliminated(), columns=shares))

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_block")
        prev, next_ = interface(part)
        return part[[*keys, "_block"]].assign(_prev=prev, _next=next_)

    alone = F.element_at("_own", 1) & F.element_at("_own", -1)
    many = packed.where(~alone).mapInPandas(eliminate, named + "".join(f", {c} double" for c in shares))
    around = many.groupBy(*keys).applyInPandas(meet, named + ", _prev double, _next double")

    def substitute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            blocks = _batch(part)
            made = blocks.solved(part["_prev"].to_numpy(float), part["_next"].to_numpy(float))
            own = [np.asarray(o, bool) for o in part["_own"]]
            ends = {}
            for name, side, (a, b) in (("_left", blocks.left, (0, 1)), ("_right", blocks.right, (-2, -1))):
                ends[name] = [[x[a], y[a], m[a], x[b], y[b], m[b]] if s else None
                              for s, x, y, m in zip(side, part["_x"], part["_y"], made)]
            yield part[keys].assign(_at=[a[o] for a, o in zip(part["_at"], own)], _m=[m[o] for m, o in zip(made, own)], **ends)

    solved = packed.join(around, [*keys, "_block"], "left").mapInPandas(substitute, ", ".join([
        *[f"`{k}` {types[k]}" for k in keys], f"_at {types['_at']}", "_m array<double>", "_left array<double>", "_right array<double>"]))
    solved = stage(solved)
    knots = solved.select(*keys, F.inline(F.arrays_zip("_at", "_m")))
    return knots, solved.groupBy(*keys).agg(F.max("_left").alias("_left"), F.max("_right").alias("_right"))


def with_curvatures(rows: DataFrame, knots: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Adds ``_m`` to the rows that are knots; positions are unique, so no key is hot.

    Only rows with a value can be knots: the others, most of a sparse series,
    are not dealt out.
    """
    named = knots.withColumnRenamed("_at", pos)
    with_value = rows.where(F.col(value).isNotNull()).join(named, [*keys, pos], "left")
    without = rows.where(F.col(value).isNull()).withColumn("_m", F.lit(None).cast("double"))
    return with_value.unionByName(without)


def with_spline(near: DataFrame, axis: str, value: str, name: str) -> DataFrame:
    """Adds ``name``, the spline at missing rows.

    Needs ``prev`` and ``next`` with axis and ``_m``, and the end cubics of the
    series, which reach on beyond the first and last knot.
    """
    fields = ["x0", "y0", "m0", "x1", "y1", "m1"]
    end = lambda side: F.struct(*[F.element_at(side, k + 1).alias(f) for k, f in enumerate(fields)])
    between = F.struct(*[F.col(f"{p}.{c}").cast("double").alias(f) for f, (p, c) in zip(
        fields, [(p, c) for p in ("prev", "next") for c in ("axis", "value", "_m")])])
    piece = F.when(F.col(value).isNull(), F.when(F.col("prev").isNull(), end("_left")).when(
        F.col("next").isNull(), end("_right")).otherwise(between))
    # step by step: one expression would repeat itself beyond what a generated method may hold
    out = near.withColumn("_p", piece).withColumn("_h", F.nullif(F.col("_p.x1") - F.col("_p.x0"), F.lit(0.0)))
    out = out.withColumns({"_a": (F.col("_p.x1") - F.col(axis)) / F.col("_h"), "_b": (F.col(axis) - F.col("_p.x0")) / F.col("_h")})
    a, b, h = F.col("_a"), F.col("_b"), F.col("_h")
    cubic = a * F.col("_p.y0") + b * F.col("_p.y1") + (
        (a * a * a - a) * F.col("_p.m0") + (b * b * b - b) * F.col("_p.m1")) * h * h / 6.0
    out = out.withColumn("_c", cubic)
    return out.withColumn(name, F.when(~F.isnan("_c"), F.col("_c"))).drop("_p", "_h", "_a", "_b", "_c")


def spline_values(
    rows: DataFrame, keys: Sequence[str], pos: str, axis: str, value: str, name: str, block: int | None = BLOCK,
) -> DataFrame:
    """IMP3: adds ``name``, the spline through the valid values, at missing rows.

    Series with fewer than four values get NULL.
    """
    knots, ends = spline_curvatures(rows, keys, pos, axis, value, None, block)
    work = with_curvatures(rows.withColumn("axis", F.col(axis).cast("double")), knots, keys, pos, value)
    near = valid_neighbours(work, keys, pos, value, block, extra=["axis", "_m"], series=ends)
    return with_spline(near, "axis", value, name).drop(
        "prev", "next", "series_first", "series_last", "axis", "_m", "_left", "_right")
