"""Joins with one row per key, where a key may hold a large share of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a key that meet in one task at about most, or this share of all rows if that is more.
ROWS, SHARE = 20_000, 1_000
#: Rows that are sorted or aggregated in one task at about most.
TASK = 1_000_000


def partitions_for(df: DataFrame, rows: int, each: int | None = None) -> int:
    """As many partitions as the session deals, or more if a task would get more than ``each`` (``TASK``) of ``rows``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (each or TASK)))


def spread(df: DataFrame, rows: int, *on: str, each: int | None = None) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``on``, so that a task's share does not grow with the input."""
    return df.repartition(partitions_for(df, rows, each), *on)


def spread_if_many(df: DataFrame, rows: int, *on: str) -> DataFrame:
    """spread() where the session's partitions would be too large; else ``df``, whose rows an aggregation may merge first."""
    return spread(df, rows, *on) if partitions_for(df, rows) > partitions_for(df, 0) else df


def sizes_of(table: DataFrame, size: str) -> tuple[int, int]:
    """Sum and maximum of the sizes."""
    return tuple(v or 0 for v in table.agg(F.sum(size), F.max(size)).first())


def join_one(
    rows: DataFrame, table: DataFrame, on: list[str], size: str, rows_each: int = ROWS, how: str = "inner",
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and tells in ``size`` how many rows hold it.

    Keys with more than ``rows_each`` rows, and more than a thousandth of all,
    are salted: their one row is repeated for each salt.  So there are a
    thousand such keys at most, and only they are broadcast.  Salts follow the
    rows' place in their files: stage ``rows`` and ``table``.  Rows are dealt over more
    tasks than the session says where each would get more than ``TASK``.  Both sides call
    the key alike; NULL keys find nothing.  ``sizes`` may be given where sizes_of() is known.
    """
    total, most = sizes or sizes_of(table, size)
    bar = max(rows_each, total // SHARE)
    if most <= bar:
        return spread_if_many(rows, total, *on).join(table, on, how)
    big = F.broadcast(table.filter(F.col(size) > bar).select(*on, F.ceil(F.col(size) / bar).alias("_salts")).distinct())
    salted = rows.join(big, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    repeated = table.join(big, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread_if_many(salted, total, *on, "_salt").join(repeated, [*on, "_salt"], how).drop("_salt")
