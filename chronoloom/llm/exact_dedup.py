"""Exact duplicates by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from chronoloom.operators.skew import join_one
from chronoloom.llm.text import ascii_lower
from chronoloom.session import stage

#: Characters of the prefix that is hashed.
PREFIX = 256
#: Slots of the table of surviving groups: what is broadcast has this many longs at most, whatever the input.
SLOTS = 1 << 20


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: Sequence[str] = (),
                prefix: int = PREFIX, slots: int = SLOTS, digest: str | None = None) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest key stays.

    One row per input row: ``key``, the ``carry`` columns, ``keep_id``,
    ``group_size``, ``kept``, and with ``digest`` a column of that name with
    the SHA-256 of each normalised text in lowercase hex.

    Groups are refined: by length in bytes, then by the hash of a prefix (one
    aggregation, both are read off the same scan), and only rows of groups with
    two members or more are read in full for SHA-256, and compared.  With
    ``digest`` the other rows are hashed in that scan too, as the result asks
    for it; no text is hashed twice.  Surviving groups reach the second scan as
    numbers of a fixed number of slots, so the broadcast has a bound; two
    groups in one slot cost a needless hash and change nothing.  Texts never
    move between tasks, and rows of a large group are salted.

    NULL text counts as empty; empty texts are one group.  Of rows repeating
    the largest key exactly one stays.  NULL keys are smaller than any other.
    An empty table gives an empty table; further columns are ignored, whatever
    their names.
    """
    rows = docs.select(
        F.col(key).alias("_key"), F.struct(F.lit(0), *carry).alias("_carry"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumns({
        "_length": F.octet_length("_text"),
        "_head": F.xxhash64(ascii_lower(F.substring("_text", 1, prefix)))})
    slot = F.pmod(F.xxhash64("_length", "_head"), F.lit(slots))
    alive = (rows.groupBy("_length", "_head").count().filter("count > 1")
             .select(slot.alias("_slot")).distinct().withColumn("_alive", F.lit(True)))
    marked = rows.withColumn("_slot", slot).join(F.broadcast(alive), "_slot", "left")
    full = F.sha2(ascii_lower(F.col("_text")), 256)
    narrow = stage(marked.select(
        "_key", "_carry", "_length", "_head", F.coalesce("_alive", F.lit(False)).alias("_alive"),
        (full if digest else F.when(F.col("_alive"), full)).alias("_full"), F.monotonically_increasing_id().alias("_row")))
    same = ["_length", "_head", "_full"]
    groups = stage(narrow.filter("_alive").groupBy(*same).agg(F.max(F.struct("_key", "_row")).alias("_keep"), F.count("*").alias("_size"))
                   .filter("_size > 1"))
    lone = F.struct("_key", "_row")
    joined = join_one(narrow.filter("_alive"), groups, same, "_size", how="left").select(
        "_key", "_carry", "_full", "_row", F.coalesce("_keep", lone).alias("_keep"), F.coalesce("_size", F.lit(1)).alias("_size"))
    every = joined.union(narrow.filter("NOT _alive").select("_key", "_carry", "_full", "_row", lone, F.lit(1).cast("long")))
    return every.select(
        F.col("_key").alias(key), *[F.col("_carry").getField(c).alias(c) for c in carry],
        F.col("_keep._key").alias("keep_id"), F.col("_size").cast("long").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"), *([F.col("_full").alias(digest)] if digest else []))
