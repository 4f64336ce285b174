"""The corpus pipeline: language, exact copies, near copies, mixing, packing.

Each stage maps ``documents`` to what it keeps of it; the last one gives the
packed pieces.  ``run`` applies all to the table of a folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoloom.llm import exact_dedup as dd, langid as li, mixing as mx, packing as pk, simhash_trie as st
from chronoloom.llm.queries import tokenizer_path
from chronoloom.llm.text import id_crc, word_count
from chronoloom.session import stage

#: SQL has no words for language models, fingerprints, flows and tokens.
ORACLE_SQL = None
ROW = "_row_of_stage"
#: Slots of the names of dropped rows: so many longs at most are broadcast, whatever the input.
SLOTS = 1 << 20
#: A text of so many bytes is in no language if no language's output is above this.
REJECTED, ENOUGH = -0.25, 200


def numbered(docs: DataFrame) -> DataFrame:
    """Adds a name for each row, the same whenever the rows are read: its file and place there."""
    name = F.concat_ws("#", "_metadata.file_name", "_metadata.row_index")
    try:
        return docs.withColumn(ROW, name)
    except AnalysisException:  # not read from files
        return stage(docs).withColumn(ROW, name)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """All rows but those named.

    Names fall to a fixed number of slots, which are broadcast.  Rows in a slot
    without a dropped one stay where they are; only the others, few unless a
    large part is dropped, are joined by name, so most texts are not shuffled.
    """
    names = stage(dropped.select(ROW))
    slot = F.pmod(F.xxhash64(ROW), F.lit(SLOTS)).alias("_slot_of_row")
    hit = F.broadcast(names.select(slot).distinct())
    rows = docs.withColumn("_slot_of_row", slot)
    clear = rows.join(hit, "_slot_of_row", "left_anti")
    doubted = rows.join(hit, "_slot_of_row", "left_semi").join(names, ROW, "left_anti")
    return clear.select(*docs.columns).union(doubted.select(*docs.columns)).drop(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are in no language learned: NULL texts, texts without a letter, and texts of ``ENOUGH``
    bytes for which the output of every language stays at ``REJECTED`` or below.

    A text without any known n-gram gets about -0.5, one in a language learned
    above 0; shorter texts have too few n-grams to be rejected for that.
    Columns of ``docs`` are kept, whatever their names; an empty table gives an
    empty one.
    """
    held = (id_crc(F.col("doc_id")) % 4) == 2
    judged = li.judged(docs, docs.filter(~held).select("text", "lang"), into="_of_language")
    found = F.col("_of_language")
    claimed = (found["margin"] > REJECTED) | (F.octet_length("text") < ENOUGH)
    return judged.filter((found["lang_pred"] != li.UNKNOWN) & claimed).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    rows = numbered(docs)
    return without(rows, dd.exact_dedup(rows, carry=[ROW]).filter(~F.col("kept")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the row with the smallest doc_id stays, of rows repeating that the first.

    Rows of a group that has no doc_id at all stay.
    """
    rows = numbered(docs)
    found = stage(st.near_copies(rows, carry=(ROW,)).select("doc_id", "component_id", ROW))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    again = (found.filter(first & F.col("doc_id").isNotNull()).groupBy("component_id")
             .agg(F.min(ROW).alias("_stays"), F.count("*").alias("_n")).filter("_n > 1"))
    repeated = found.filter(first).join(again, "component_id").filter(F.col(ROW) != F.col("_stays"))
    return without(rows, found.filter(~first).select(ROW).union(repeated.select(ROW)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it."""
    rows = numbered(docs)
    sized = rows.select(ROW, "source", word_count(F.col("text")).alias("size"))
    mixed = mx.mix_by_source(sized, key=ROW).filter("taken > 0").select(ROW, (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    return (rows.join(mixed, ROW).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece of a document."""
    return pk.pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("exact copies", exact_copies), ("near copies", near_copies), ("mixture", mixture),
          ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
