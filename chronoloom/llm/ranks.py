"""Positions inside few, possibly huge groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Rows that meet in one window at about most, whatever a group holds.
ROWS = 20_000


def positions(df: DataFrame, groups: list[str], order: list[str], measure: str | None = None, seed: int = 0,
              rows: int = ROWS) -> DataFrame:
    """Adds each row's place in its group, in a seeded order that is the same in every run.

    Rows are ordered by a hash of the ``order`` columns.  Ranges of the hash
    cut a group into pieces of about ``rows`` rows; only the totals of pieces
    are summed across a group.  Columns added: ``_place`` (gapless from 0),
    ``_piece``, and, with ``measure``, ``_before`` (sum of it over earlier
    rows), ``_from`` and ``_to`` (that sum at both ends of the piece).

    The number of groups must be bounded by the caller (shards, lengths,
    patterns), their totals are broadcast; rows equal in all of ``order``
    share a piece.  ``df`` is read three times: stage it if it is costly.
    An empty table gives an empty one.
    """
    same = lambda a, b: [a[g].eqNullSafe(b[g]) for g in groups]
    size = F.col(measure).cast("double" if dict(df.dtypes)[measure] == "double" else "long") if measure else F.lit(0)
    hashed = df.withColumns({"_hash": F.xxhash64(F.lit(seed), *order), "_size": size})
    totals = hashed.groupBy(*groups).agg(F.ceil(F.count("*") / rows).alias("_pieces"))
    t = F.broadcast(totals)
    part = (hashed.join(t, same(hashed, t)).drop(*[t[g] for g in groups])
            .withColumn("_piece", F.floor(F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53)) * F.col("_pieces"))))
    sums = part.groupBy(*groups, "_piece").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *groups, "_piece",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_from"), "_sum")
    joined = part.join(starts, [*same(part, starts), part["_piece"] == starts["_piece"]]).drop(
        *[starts[g] for g in groups], starts["_piece"])
    inside = Window.partitionBy(*groups, "_piece").orderBy("_hash", *order)
    out = joined.withColumns({
        "_place": F.col("_first") + F.row_number().over(inside) - 1,
        "_before": F.col("_from") + F.coalesce(F.sum("_size").over(
            inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_to": F.col("_from") + F.col("_sum"),
    })
    return out.select(*df.columns, "_place", "_piece", *(["_before", "_from", "_to"] if measure else []))
