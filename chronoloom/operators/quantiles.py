"""Exact, linearly interpolated quantiles by radix selection, without holding a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in the task
that finishes it.  Here a double becomes a long of the same order, and a wanted
order statistic is found digit by digit: rows are counted per bucket of leading
bits (tasks merge their counts before anything is shuffled), the bucket that
holds the rank is kept, and only its rows are counted at the next twelve bits.
After the first count equal values are one row, so a value that fills a group
costs one row a task.  What meets in one task is the histogram of a bucket or a
bucket small enough to sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chronoloom.operators.skew import join_one, sizes_of
from chronoloom.session import stage

#: Bits that a level tells apart, and rows of a bucket that are sorted at once.
DIGIT, SORTED = 12, 1 << 18
MANTISSA = 52
_ONE = float(1 << MANTISSA)
_SUBNORMAL = 2.0 ** -1022


def order_key(value: Column) -> Column:
    """A long that orders as the double does: exponent and mantissa bits, negated for negative values.

    Zeros of either sign are one value.  NaN has no place in the order and must
    be filtered before.
    """
    size = F.abs(value)
    near = F.floor(F.log2(size))  # may miss by one next to a power of two
    two = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(two(near) > size, near - 1).when(two(near + 1) <= size, near + 1).otherwise(near)
    normal = (exponent + 1023) * F.lit(1 << MANTISSA) + ((size / two(exponent) - 1.0) * F.lit(_ONE)).cast("long")
    small = (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    key = (F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 << MANTISSA))
           .when(size < F.lit(_SUBNORMAL), small).otherwise(normal)).cast("long")
    return F.when(value < 0, -key).otherwise(key)


def value_of(key: Column) -> Column:
    """The double of an order key."""
    size = F.abs(key)
    exponent, rest = F.shiftright(size, MANTISSA), size.bitwiseAND(F.lit((1 << MANTISSA) - 1))
    normal = (rest / F.lit(_ONE) + 1.0) * F.pow(F.lit(2.0), exponent - 1023)
    double = (F.when(exponent == 2047, F.lit(float("inf"))).when(exponent == 0, rest * F.lit(2.0 ** -1074)).otherwise(normal))
    return F.when(key < 0, -double).otherwise(double)


def _ends(histogram: DataFrame, parent: list[str], at: str) -> DataFrame:
    """Adds ``_start`` and ``_end``, the ranks that a row of the histogram covers inside its parent."""
    order = Window.partitionBy(*parent).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("_end", F.sum("_c").over(order)).withColumn("_start", F.col("_end") - F.col("_c"))


def _located(histogram: DataFrame, targets: DataFrame, parent: list[str], at: str) -> DataFrame:
    """The row of the histogram that holds each target's ``_rank``, which becomes the rank inside that row."""
    met = _ends(histogram, parent, at).join(targets, parent).where(F.col("_rank").between(F.col("_start"), F.col("_end") - 1))
    return met.withColumn("_rank", F.col("_rank") - F.col("_start")).drop("_start", "_end", "_c")


def order_statistics(rows: DataFrame, place: DataFrame, digit: int = DIGIT, few: int = SORTED) -> DataFrame:
    """(_g, _t, _key) of targets that are located down to a bucket of exponents.

    ``rows`` are (_g, _key), ``place`` is (_g, _t, _rank, _bucket, _size); both
    are read several times: stage them.
    """
    shift = MANTISSA
    rows = rows.withColumn("_c", F.lit(1).cast("long"))
    while shift:
        held = place.groupBy("_g", "_bucket").agg(F.max("_size").alias("_size"))
        sizes = sizes_of(held, "_size")
        near = join_one(rows.withColumn("_bucket", F.shiftright("_key", shift)), held, ["_g", "_bucket"], "_size", sizes=sizes)
        near = near.groupBy("_g", "_bucket", "_key").agg(F.sum("_c").alias("_c"))
        if sizes[1] <= few:
            return _located(near, place.drop("_size"), ["_g", "_bucket"], "_key").select("_g", "_t", "_key")
        near = stage(near.withColumnRenamed("_bucket", "_parent"))
        shift = max(0, shift - digit)
        counts = near.groupBy("_g", "_parent", F.shiftright("_key", shift).alias("_bucket")).agg(
            F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_size"))
        inside = place.select("_g", F.col("_bucket").alias("_parent"), "_t", "_rank")
        place = stage(_located(counts, inside, ["_g", "_parent"], "_bucket").drop("_parent"))
        rows = near.drop("_parent")
    return place.select("_g", "_t", F.col("_bucket").alias("_key"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], few: int = SORTED,
) -> DataFrame:
    """One row per group with one column per probability.

    Same definition as ``percentile``: position ``p * (n - 1)``, linear in
    between.  Missing values and NaN do not count, groups without a value give
    no row; NULL is a group like any other.  A group, and then a bucket, with
    more than ``few`` rows (below the first level: distinct values) is divided
    before it is sorted.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.select(group.alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = stage(rows.select("_g", order_key(F.col("_v")).alias("_key")))
    position = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("_t"), (F.ceil(h) if up else F.floor(h)).cast("long").alias("_rank"))
                       for i, h in enumerate(position) for up in (0, 1)])
    covered = F.filter(wanted, lambda w: w["_rank"].between(F.col("_start"), F.col("_end") - 1))

    def places(counts: DataFrame, at: str) -> DataFrame:
        """Which rows of a histogram of whole groups hold the wanted ranks; needs no join, as each knows what it covers."""
        ends = _ends(counts, ["_g"], at).withColumn("_n", F.sum("_c").over(Window.partitionBy("_g")))
        return ends.select("_g", "_n", at, "_c", "_start", F.explode(covered).alias("_w"))

    largest = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0] or 0
    if largest <= few:  # no group has to be divided
        found = places(rows.groupBy("_g", "_key").agg(F.count(F.lit(1)).alias("_c")), "_key").select("_g", "_n", "_key", "_w._t")
    else:
        counts = rows.groupBy("_g", F.shiftright("_key", MANTISSA).alias("_bucket")).agg(F.count(F.lit(1)).alias("_c"))
        place = stage(places(counts, "_bucket").select(
            "_g", "_n", "_bucket", F.col("_c").alias("_size"), F.col("_w._t").alias("_t"), (F.col("_w._rank") - F.col("_start")).alias("_rank")))
        found = order_statistics(rows, place.drop("_n"), few=few).join(place.select("_g", "_t", "_n"), ["_g", "_t"])
    at = {t: F.max(F.when(F.col("_t") == t, value_of(F.col("_key")))).alias(f"_a{t}") for t in range(2 * len(probs))}
    wide = found.groupBy("_g", "_n").agg(*at.values())
    out = []
    for i, h in enumerate(position):
        a, b = F.col(f"_a{2 * i}"), F.col(f"_a{2 * i + 1}")
        out.append((a + (b - a) * (h - F.floor(h))).alias(names[i]))
    return wide.select(*[F.col("_g").getField(k).alias(k) for k in keys], *out)
