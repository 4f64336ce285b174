"""Nearest-neighbour imputation with missing coordinates (IMP6, SCL14).

The distance between two rows uses the coordinates both have, scaled up by the
share that is missing.  The rows of a station are put in an order that keeps
rows with the same missing coordinates and nearby values together, and cut into
leaves of bounded size; a station that fits one is searched as it is.  Leaves
are the bottom of a tree of boxes: a node knows
the range of each coordinate among its rows, which coordinates any and all of
them have, and how many they are.  From that follows how near and how far rows
of two nodes can be.  A leaf of incomplete rows goes down the tree level by
level and keeps the nodes that can hold one of its nearest neighbours; the rest
is ruled out exactly, not approximately.  Neighbouring leaves ask in a group, to
which each leaf that remains is sent once.  These are met nearest first, and each
row passes over those beyond the k it has.  Only the mean of the k nearest
leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoloom.operators.skew import join_one, spread
from chronoloom.session import stage

#: Rows of a leaf, children of a node, leaves of a station that meet its top nodes in one task.
BLOCK, FAN, ASKING = 512, 32, 256
#: Halvings of a coordinate's range that the order of rows follows; rows, and pairs of leaves, that one task searches at about most.
HALVINGS, SEARCHED, PAIRS = 6, 50_000, 1_000
#: Leaves ask in groups, so large that a donor leaf is sent about so many times for each leaf that asks, but donors held at once by a group are no more than so many.
COPIES, HELD = 8, 1_000_000
#: Rows and donors with the same coordinates each are met in order where they make so many pairs on average; fewer all by products.
WORTH = 20_000
# distances are compared at this resolution, so that the order of additions
# does not decide a tie; remaining ties go to the smaller row id
DECIMALS = 9


def _order(z: Sequence[Column]) -> Column:
    """Text that sorts rows: which coordinates are there, then in which half of its range each is, then in which quarter, ...

    Coordinates are interleaved, so that neighbours in this order are mostly
    near in all of them.  Ranges are halved on the logistic scale, where values
    about the mean lie evenly.
    """
    there = [F.when(c.isNotNull(), "1").otherwise("0") for c in z]
    places = 1 << HALVINGS
    at = [F.least(F.floor(F.coalesce(1.0 / (1.0 + F.exp(c * -1.7)), F.lit(0.0)) * places), F.lit(places - 1)).cast("long") for c in z]
    halves = [F.when(c.bitwiseAND(F.lit(places >> (h + 1))) > 0, "1").otherwise("0") for h in range(HALVINGS) for c in at]
    return F.concat(*there, *halves)


def standardised(df: DataFrame, station: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """SCL14: adds ``_z`` and returns the statistics, arrays in column order.  Rows of a large station are salted."""
    stats = stage(df.groupBy(*station).agg(
        F.array(*[F.avg(c) for c in columns]).alias("_mean"),
        F.array(*[F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)) for c in columns]).alias("_std"),
        F.count(F.lit(1)).alias("_rows")))
    z = F.array(*[(F.col(c).cast("double") - F.col("_mean")[j]) / F.col("_std")[j] for j, c in enumerate(columns)])
    return join_one(df, stats, list(station), "_rows").withColumn("_z", z), stats


def _flat() -> list[Column]:
    """``ids`` and flat ``values`` of the rows in ``_list``, with NaN for missing."""
    flat = F.flatten(F.transform("_list", lambda r: F.transform(r["_z"], lambda x: F.coalesce(x, F.lit(float("nan"))))))
    return [F.transform("_list", lambda r: r["id"]).alias("ids"), flat.alias("values")]


def pack_leaves(rows: DataFrame, station: Sequence[str], row: str, width: int, block: int) -> DataFrame:
    """One row per leaf: (station, leaf, ids, values flat with NaN for missing), of about ``block`` rows in order."""
    z = [F.col("_z")[j] for j in range(width)]
    rows = stage(rows.select(*station, row, "_z", _order(z).alias("_cell")))
    cells = rows.groupBy(*station, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # two steps, so that the cells of a station never meet in one task
    cells = stage(cells.withColumn("_part", F.substring("_cell", 1, width + 8)))
    parts = cells.groupBy(*station, "_part").agg(F.sum("_n").alias("_sum"))
    before = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_from", F.coalesce(F.sum("_sum").over(before(station, "_part")), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("_n").over(before([*station, "_part"], "_cell")), F.lit(0))
    cells = stage(cells.withColumn("_inside", inside).join(parts, [*station, "_part"]).select(
        *station, "_cell", "_n", (F.col("_from") + F.col("_inside")).alias("_offset")))
    placed = join_one(rows, cells, [*station, "_cell"], "_n")
    spot = F.col("_offset") + F.pmod(F.xxhash64(row), F.col("_n"))
    placed = placed.withColumn("leaf", F.floor(spot / block).cast("long"))
    listed = placed.groupBy(*station, "leaf").agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("id"), "_z"))).alias("_list"))
    return listed.select(*station, "leaf", *_flat())


def leaf_boxes(leaves: DataFrame, station: Sequence[str], width: int) -> DataFrame:
    """(station, node, n, lo, hi, whole): range of each coordinate (NULL if no row has it), and whether all rows have it."""
    at = lambda j: F.filter("values", lambda v, i: i % width == j)
    there = lambda j: F.filter(at(j), lambda v: ~F.isnan(v))
    return leaves.select(
        *station, F.col("leaf").alias("node"), F.size("ids").cast("long").alias("n"),
        F.array(*[F.array_min(there(j)) for j in range(width)]).alias("lo"),
        F.array(*[F.array_max(there(j)) for j in range(width)]).alias("hi"),
        F.array(*[F.size(there(j)) == F.size("ids") for j in range(width)]).alias("whole"))


def parents(nodes: DataFrame, station: Sequence[str], width: int, fan: int) -> DataFrame:
    """The next level of the tree: boxes around ``fan`` neighbouring nodes."""
    each = lambda f, c: F.array(*[f(F.col(c)[j]) for j in range(width)]).alias(c)
    return nodes.groupBy(*station, F.floor(F.col("node") / fan).cast("long").alias("node")).agg(
        F.sum("n").alias("n"), each(F.min, "lo"), each(F.max, "hi"), each(F.bool_and, "whole"))


def bounds(q: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """How near and how far a row of ``q`` can be to one of each node, and whether they surely share a coordinate.

    A pair shares all coordinates that both sides have in every row, and maybe
    some that both have in some: those that help most are counted.
    """
    width = lo.shape[1]
    maybe = ~np.isnan(lo) & ~np.isnan(q["lo"])[None]
    sure = whole & q["whole"][None] & maybe
    with np.errstate(invalid="ignore"):
        gap = np.maximum(np.maximum(lo - q["hi"], q["lo"] - hi), 0.0) ** 2
        far = np.maximum(np.abs(hi - q["lo"]), np.abs(q["hi"] - lo)) ** 2
    count = sure.sum(1)
    out = []
    for square, sign, best in ((gap, 1, np.min), (far, -1, np.max)):
        fixed = np.where(sure, square, 0.0).sum(1)
        free = np.sort(np.where(maybe & ~sure, sign * square, np.inf), axis=1)
        total = fixed[:, None] + sign * np.cumsum(np.where(np.isinf(free), 0.0, free), axis=1)
        mean = np.where(np.isinf(free), sign * np.inf, total / (count[:, None] + 1 + np.arange(width)))
        alone = np.where(count > 0, fixed / np.maximum(count, 1), sign * np.inf)
        out.append(width * best(np.column_stack([alone, mean]), axis=1))
    return out[0], out[1], count > 0, maybe.any(1)


def kept_nodes(q: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray, whole: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes can hold one of the k nearest donors of some row and column that ``q`` lacks, and how near they can be."""
    nearest_, farthest, sure, shared = bounds(q, lo, hi, whole)
    keep = np.zeros(len(n), bool)
    for c in np.flatnonzero(~q["whole"]):
        can = np.flatnonzero(~np.isnan(lo[:, c]) & shared)
        known = can[whole[can, c] & sure[can]]
        order = known[np.argsort(farthest[known], kind="stable")]
        enough = np.flatnonzero(np.cumsum(n[order]) >= k)
        reach = farthest[order[enough[0]]] if len(enough) else np.inf
        keep[can[nearest_[can] <= reach * (1 + 1e-9) + 1e-9]] = True
    return keep, nearest_


def candidate_pairs(leaves: DataFrame, station: Sequence[str], width: int, k: int, fan: int = FAN) -> DataFrame:
    """(station, q_leaf, d_leaf, near): leaves that can hold a nearest neighbour, found by going down the tree."""
    levels = [stage(leaf_boxes(leaves, station, width))]
    most = levels[0].agg(F.max("node")).first()[0]
    while most is not None and most >= fan:
        levels.append(stage(parents(levels[-1], station, width, fan)))
        most //= fan
    box = ["lo", "hi", "whole"]
    asking = levels[0].where(F.exists("whole", lambda w: ~w)).select(*station, F.col("node").alias("q_leaf"), *[F.col(c).alias(f"q_{c}") for c in box])
    types = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in station] + ["q_leaf long", "node long", "near double"])

    def prune(part: pd.DataFrame) -> pd.DataFrame:
        matrix = lambda c, kind: np.array([np.asarray(v, kind) for v in part[c]])
        first = part.iloc[0]
        q = {c: np.asarray(first[f"q_{c}"], bool if c == "whole" else float) for c in box}
        keep, near = kept_nodes(q, matrix("lo", float), matrix("hi", float), matrix("whole", bool), part["n"].to_numpy(), k)
        # a leaf's own rows come first
        near = np.where(part["node"].to_numpy() == first["q_leaf"], -1.0, near) if first["_leaves"] else near
        return part.assign(near=near).loc[keep, [*station, "q_leaf", "node", "near"]]

    asked = asking.count()
    # a station's top nodes are few; copies of them keep its leaves from meeting in one task
    counts = asking.groupBy(*station).agg(F.ceil(F.count(F.lit(1)) / ASKING).alias("_salts"))
    top = levels[-1].join(counts, list(station)).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    dealt = asking.join(counts, list(station)).withColumn("_salt", F.pmod(F.xxhash64("q_leaf"), F.col("_salts"))).drop("_salts")
    met = dealt.join(top, [*station, "_salt"]).drop("_salt")
    for level in range(len(levels) - 1, -1, -1):
        found = spread(met.withColumn("_leaves", F.lit(level == 0)), asked, *station, "q_leaf", each=PAIRS).groupBy(*station, "q_leaf").applyInPandas(prune, schema)
        if level:
            below = levels[level - 1].withColumnRenamed("node", "_child").withColumn("node", F.floor(F.col("_child") / fan).cast("long"))
            met = stage(found.drop("near")).join(below, [*station, "node"]).drop("node").withColumnRenamed("_child", "node").join(asking, [*station, "q_leaf"])
    return found.withColumnRenamed("node", "d_leaf")


def groups_of(pairs: DataFrame, leaves: DataFrame, station: Sequence[str], size: int) -> DataFrame:
    """(station, q_leaf, near, asks, gives, ids, values): ``size`` neighbouring leaves ask together.

    A leaf goes to each group once, however many of the group it may matter to,
    and the asking leaves of a group go to it before the donors.
    """
    group = F.floor(F.col("q_leaf") / size).cast("long").alias("q_leaf")
    met = stage(pairs.groupBy(*station, group, "d_leaf").agg(F.min("near").alias("near")))
    payload = [F.col("ids"), F.col("values")]
    gives = met.join(leaves.withColumnRenamed("leaf", "d_leaf"), [*station, "d_leaf"]).select(
        *station, "q_leaf", "near", F.lit(False).alias("asks"), F.lit(True).alias("gives"), *payload)
    asks = leaves.where(F.exists("values", F.isnan)).withColumnRenamed("leaf", "q_leaf").select(
        *station, group, F.lit(-2.0).alias("near"), F.lit(True).alias("asks"), F.lit(False).alias("gives"), *payload)
    return spread(asks.union(gives), met.count(), *station, "q_leaf", each=PAIRS).sortWithinPartitions(*station, "q_leaf", "near")


def leaf_search(both: DataFrame, station: Sequence[str], row_type: str, width: int, k: int) -> DataFrame:
    """(station, id, fills): for each incomplete row the mean value of its k nearest donors in each column it lacks.

    ``both`` has one row per leaf that asks or gives in a group of leaves; those
    of a group follow each other in one partition, first all that ask.
    """
    types = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in station] + [f"id {row_type}, fills array<double>"])

    def made(names: list, ids: list, fills: list) -> pd.DataFrame:
        out = pd.DataFrame({c: [n[i] for n in names] for i, c in enumerate(station)})
        out["id"], out["fills"] = ids, fills
        return out[[*station, "id", "fills"]]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, asking, leaves, waiting = None, None, [], ([], [], [])

        def close() -> None:
            for i, fills in asking.means():
                waiting[0].append(current[:-1])
                waiting[1].append(asking.ids[i])
                waiting[2].append(fills)

        for pdf in batches:
            for r in pdf.to_dict("records"):
                key = (*[r[c] for c in station], r["q_leaf"])
                if key != current:
                    if asking:
                        close()
                    current, asking, leaves = key, None, []
                values = np.asarray(r["values"], dtype=float)
                if r["asks"]:
                    leaves.append((r["ids"], values))
                if r["gives"]:
                    if not asking:
                        asking = Asking([i for ids, _ in leaves for i in ids], np.concatenate([v for _, v in leaves]), width, k)
                    asking.meet(np.asarray(r["ids"]), values.reshape(-1, width))
                if len(waiting[0]) >= 20_000:
                    yield made(*waiting)
                    waiting = ([], [], [])
        if asking:
            close()
        if waiting[0]:
            yield made(*waiting)

    return both.mapInPandas(search, schema)


def alike(there: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which coordinates are there, and the rows where it is these."""
    if not len(there):
        return []
    kinds, of, n = np.unique(there, axis=0, return_inverse=True, return_counts=True)
    return list(zip(kinds, np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(n)[:-1])))


class Asking:
    """The incomplete rows of leaves and the k nearest donors met so far in each column that they lack."""

    def __init__(self, ids: Sequence, values: np.ndarray, width: int, k: int):
        z = np.asarray(values, dtype=float).reshape(-1, width)
        rows = np.flatnonzero(np.isnan(z).any(1))
        self.ids, self.width, self.k = [ids[i] for i in rows], width, k
        self.has = ~np.isnan(z[rows])
        self.z = np.nan_to_num(z[rows])
        self.sides = np.hstack([self.z**2, -2 * self.z, self.has.astype(float)])
        self.size = (self.z**2).sum(1)
        self.kinds = alike(self.has)
        # distance of the k-th donor of each row and column
        self.reach = np.where(self.has, -1.0, np.inf)
        # of each row and column: distances, names and values of its donors
        self.dist, self.value = np.full((self.has.size, k), np.inf), np.zeros((self.has.size, k))
        self.donor: np.ndarray | None = None

    def meet(self, d_ids: np.ndarray, d: np.ndarray) -> None:
        """Takes up what a leaf of donors has."""
        there = ~np.isnan(d)
        kinds = alike(there)
        if len(self.ids) * len(d) >= WORTH * len(self.kinds) * len(kinds):
            d0 = np.nan_to_num(d)
            found = [x for has, rows in self.kinds for some, donors in kinds for x in self._beside(has, rows, some, donors, d0)]
        else:
            found = self._measured(self._dense(d, there), np.nan_to_num(d), there)
        if found:
            at, col, donor, dist = (np.concatenate(x) for x in zip(*found))
            if len(at):
                self._keep((at, col, dist, d_ids[donor], d[donor, col]))

    def _beside(self, has: np.ndarray, rows: np.ndarray, some: np.ndarray, donors: np.ndarray, d: np.ndarray) -> Iterator[tuple]:
        """Donors as near as the k nearest, for rows that all have the same coordinates and donors that do.

        Donors are put in the order of one coordinate that both have; a row looks
        at those as near in it as the k donors it has, or as k of those beside it
        there, can be.
        """
        shared, cols = np.flatnonzero(has & some), np.flatnonzero(~has & some)
        if not len(shared) or not len(cols):
            return
        d = d[donors]
        lo, hi = d[:, shared].min(0), d[:, shared].max(0)
        scale = self.width / len(shared)
        reach = self.reach[np.ix_(rows, cols)].max(1)
        gap = np.zeros(len(rows))
        for j, a, b in zip(shared, lo, hi):
            x = self.z[rows, j]
            gap += np.maximum(np.maximum(a - x, x - b), 0.0) ** 2
        wanted = np.sqrt(scale * gap) * (1 - 1e-9) <= reach + 1e-8
        rows, reach = rows[wanted], reach[wanted]
        if not len(rows):
            return
        line = int(shared[np.argmax(hi - lo)])
        order = np.argsort(d[:, line], kind="stable")
        d, donors, z, k = d[order], donors[order], self.z[rows], self.k
        there, at = d[:, line], z[:, line]

        def span(i: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
            far = (reach[i] + 1e-8) / np.sqrt(scale) * (1 + 1e-9)
            return np.searchsorted(there, at[i] - far, "left"), np.searchsorted(there, at[i] + far, "right")

        start, end = span(slice(None))
        many = np.flatnonzero(end - start > 4 * k)
        if len(many) and len(d) >= 2 * k:
            near = np.clip(np.searchsorted(there, at[many]) - k, 0, len(d) - 2 * k)[:, None] + np.arange(2 * k)
            total = sum((z[many, j][:, None] - d[near, j]) ** 2 for j in shared)
            reach[many] = np.minimum(reach[many], np.sqrt(scale * np.partition(total, k - 1, axis=1)[:, k - 1]))
            start[many], end[many] = span(many)
        n = end - start
        upto = np.cumsum(n)
        for part in np.split(np.arange(len(rows)), np.searchsorted(upto, np.arange(1_000_000, upto[-1], 1_000_000))):
            i = np.repeat(part, n[part])
            j = np.arange(len(i)) + np.repeat(start[part] - (upto[part] - n[part] - (upto[part[0]] - n[part[0]] if len(part) else 0)), n[part])
            total = np.zeros(len(i))
            for c in shared:
                total += (z[i, c] - d[j, c]) ** 2
            dist = np.round(np.sqrt(total * scale), DECIMALS)
            near = np.flatnonzero(dist <= reach[i] + 1e-8)
            i, j, dist = rows[i[near]], donors[j[near]], dist[near]
            for c in cols:
                ok = dist <= self.reach[i, c]
                yield i[ok], np.full(int(ok.sum()), c), j[ok], dist[ok]

    def _dense(self, d: np.ndarray, there: np.ndarray) -> list[tuple]:
        """(row, column, donor) that may be among the k nearest.

        Products tell distances up to an error that is allowed for; only such
        pairs are measured coordinate by coordinate.
        """
        some, whole = there.any(0), there.all(0)
        lo, hi = (np.where(some, f(np.where(there, d, e), axis=0), 0.0) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
        most = (self.has & some).sum(1)
        gap = np.maximum(np.maximum(lo - self.z, self.z - hi), 0.0) ** 2
        nearest_ = np.sqrt(self.width / np.maximum(most, 1) * np.where(self.has & whole, gap, 0.0).sum(1))
        wanted = (nearest_[:, None] * (1 - 1e-9) <= self.reach + 1e-8) & some & (most > 0)[:, None]
        rows = np.flatnonzero(wanted.any(1))
        d = np.nan_to_num(d)
        theirs, squares = there.astype(float), d**2
        found = []
        step = max(1, 1_000_000 // len(d))
        for part in (rows[i:i + step] for i in range(0, len(rows), step)):
            shared = self.has[part].astype(float) @ theirs.T
            about = self.sides[part] @ np.hstack([theirs, d, squares]).T
            with np.errstate(divide="ignore", invalid="ignore"):
                about = np.where(shared > 0, about * (self.width / shared), np.inf)
            slack = self.width * 1e-11 * (1.0 + self.size[part] + squares.sum(1).max())
            for c in np.flatnonzero(wanted[part].any(0)):
                at, can = np.flatnonzero(wanted[part, c]), np.flatnonzero(there[:, c])
                near = about if len(at) == len(part) and len(can) == len(d) else about[np.ix_(at, can)]
                if len(can) > self.k:
                    kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
                    bar = np.minimum(np.sqrt(np.maximum(kth + slack[at], 0.0)), self.reach[part[at], c])
                else:
                    bar = self.reach[part[at], c]
                i, j = np.nonzero((near <= ((bar + 1e-8) ** 2 + slack[at])[:, None]) & np.isfinite(near))
                found.append((part[at[i]], np.full(len(i), c), can[j]))
        return found

    def _measured(self, found: list[tuple], d: np.ndarray, there: np.ndarray) -> list[tuple]:
        """With distances, in one piece."""
        if not found:
            return []
        at, col, donor = (np.concatenate(x) for x in zip(*found))
        total, both = np.zeros(len(at)), np.zeros(len(at))
        for j in range(self.width):
            have = self.has[at, j] & there[donor, j]
            total += np.where(have, (self.z[at, j] - d[donor, j]) ** 2, 0.0)
            both += have
        return [(at, col, donor, np.round(np.sqrt(total * (self.width / both)), DECIMALS))]

    def _keep(self, new: tuple) -> None:
        """The k best of each row and column, ties to the smaller id; others than those of ``new`` stay as they are."""
        at, col, dist, donor, value = new
        cell = at * self.width + col
        kind = donor.dtype if donor.dtype.kind in "iuf" else np.dtype(object)
        if self.donor is None:
            self.donor = np.zeros(self.dist.shape, kind)
        elif (wider := np.result_type(self.donor, kind)) != self.donor.dtype:
            self.donor = self.donor.astype(wider)
        meets = np.zeros(len(self.dist), bool)
        meets[cell] = True
        touched = np.flatnonzero(meets)
        i, j = np.nonzero(np.isfinite(self.dist[touched]))
        held = touched[i]
        cell, dist, donor, value = (np.concatenate(x) for x in (
            (held, cell), (self.dist[held, j], dist), (self.donor[held, j], donor), (self.value[held, j], value)))
        rank = donor if donor.dtype.kind in "iu" else np.unique(donor, return_inverse=True)[1]
        order = np.lexsort((rank, dist, cell))
        cell, dist, donor, value = (x[order] for x in (cell, dist, donor, value))
        start = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
        place = np.arange(len(cell)) - np.repeat(start, np.diff(np.r_[start, len(cell)]))
        keep = place < self.k
        cell, dist, donor, value, place = (x[keep] for x in (cell, dist, donor, value, place))
        self.dist[cell, place], self.donor[cell, place], self.value[cell, place] = dist, donor, value
        last = place == self.k - 1
        self.reach.flat[cell[last]] = dist[last]

    def means(self) -> Iterator[tuple[int, list]]:
        """The rows for which a donor was found, and their means; NULL where a column has none."""
        met = np.isfinite(self.dist)
        n = met.sum(1).reshape(-1, self.width)
        total = np.zeros(len(self.dist))
        for j in range(self.k):  # one after the other, nearest first
            total += np.where(met[:, j], self.value[:, j], 0.0)
        mean = total.reshape(-1, self.width) / np.maximum(n, 1)
        for i in np.flatnonzero(n.any(1)):
            yield i, [v if m else None for v, m in zip(mean[i].tolist(), n[i].tolist())]


def knn_impute(
    df: DataFrame, station: Sequence[str], row: str, columns: Sequence[str], k: int = 5, block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """IMP6: fills the missing ``columns`` of each row from its station.

    The k nearest donors that have the column are averaged on the standardised
    scale; fewer than k are averaged as they are.  Without any donor that shares
    a coordinate the column mean is used, and a column without any value stays
    missing.  A station may have any size, and any number of columns counts.
    ``df`` is read several times: stage it.
    """
    station, width = list(station), len(columns)
    rows, stats = standardised(df, station, columns)
    row_type = dict(df.dtypes)[row]
    total, largest = (v or 0 for v in stats.agg(F.sum("_rows"), F.max("_rows")).first())

    # stations of one leaf meet only themselves
    small = spread(rows.where(F.col("_rows") <= block), total, *station, each=SEARCHED).groupBy(*station).agg(
        F.sort_array(F.collect_list(F.struct(F.col(row).alias("id"), "_z"))).alias("_list"))
    small = small.select(*station, F.lit(0).cast("long").alias("q_leaf"), F.lit(True).alias("asks"), F.lit(True).alias("gives"), *_flat())
    fills = leaf_search(small, station, row_type, width, k)
    if largest > block:
        leaves = stage(pack_leaves(rows.where(F.col("_rows") > block), station, row, width, block))
        pairs = stage(candidate_pairs(leaves, station, width, k, fan))
        met, asking = pairs.agg(F.count(F.lit(1)), F.count_distinct(*station, "q_leaf")).first()
        size = max(1, min(met // (COPIES * max(asking, 1)), HELD // (block * width * k)))
        fills = fills.union(leaf_search(groups_of(pairs, leaves, station, size), station, row_type, width, k))
    means = fills.groupBy(*station, F.col("id").alias(row)).agg(*[F.max(F.col("fills")[j]).alias(f"_fill{j}") for j in range(width)])
    out = join_one(df, stats, station, "_rows").drop("_rows").join(means, [*station, row], "left")
    filled = {
        c: F.coalesce(F.col(c).cast("double"),
                      F.coalesce(F.col(f"_fill{j}"), F.lit(0.0)) * F.col("_std")[j] + F.col("_mean")[j])
        for j, c in enumerate(columns)
    }
    return out.withColumns(filled).drop("_mean", "_std", *[f"_fill{j}" for j in range(width)])
