"""CSV sources (SRC4-SRC7, SRC9-SRC12)."""

from __future__ import annotations

import csv
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from chronoloom.functions.calendar import TIME_FORMAT, parse_time
from chronoloom.session import stage
from chronoloom.settings import ENCODINGS
from chronoloom.sources.tensor import read_tensor

TIME_COLUMNS = ("date", "timestamp", "time", "datetime")
SPLIT_FILES = {"train": "train", "val": "val", "test": "test"}


def melt(wide: DataFrame, keys: Sequence[str], names: Sequence[str], column: str = "indicator", value: str = "value") -> DataFrame:
    return wide.unpivot(list(keys), list(names), column, value)


def read_wide_csv(spark: SparkSession, path: str, fmt: str = TIME_FORMAT, time: str = "date") -> DataFrame:
    """SRC4: one time column and a float column per node, as long rows."""
    wide = spark.read.option("header", True).csv(path)
    names = [c for c in wide.columns if c != time]
    wide = wide.select(parse_time(time, fmt).alias("ts"), *[F.col(f"`{c}`").try_cast("float").alias(c) for c in names])
    return melt(wide, ["ts"], names, "node")


def byte_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, id, line)``: the bytes of each line, whatever their encoding, in splittable reads.

    The text reader cuts at line ends and hands bytes on as they are; in none
    of the encodings here is a line end part of another character.  ``start``
    and ``id`` order the lines of a file.
    """
    text = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return text.select(F.url_decode("file_path").alias("file"), F.col("file_block_start").alias("start"),
                       F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("line"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, line)``: lines of text numbered from 0 in order of files and of lines in them.

    The pieces of files that tasks read are counted, one row each, and a line's
    number is its piece's offset plus its place there.  A piece is read in one
    go, so its ids are consecutive, and no line has to be moved.
    """
    rows = byte_lines(spark, path)
    sizes = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = rows.join(F.broadcast(offsets), ["file", "start"])
    return numbered.select(F.col("line").cast("string").alias("value"), (F.col("_offset") + F.col("id") - F.col("_first")).alias("line"))


def file_encodings(lines: DataFrame) -> DataFrame:
    """``(file, encoding, header)``: the first listed encoding that decodes every line of a file, and its first line."""
    names = [n for n, _ in ENCODINGS]

    @F.pandas_udf("array<boolean>")
    def decodes(column: pd.Series) -> pd.Series:
        return pd.Series([[decodable(x, n) for n in names] for x in column])

    marked = lines.withColumn("_ok", decodes("line"))
    whole = marked.groupBy("file").agg(
        *[F.bool_and(F.col("_ok")[k]).alias(f"_ok{k}") for k in range(len(names))],
        F.min_by("line", F.struct("start", "id")).alias("_head"))
    encoding = F.coalesce(*[F.when(F.col(f"_ok{k}"), F.lit(n)) for k, n in enumerate(names)], F.lit(names[-1]))
    return whole.select("file", encoding.alias("encoding"), csv_fields("_head", encoding).alias("header"))


def decodable(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def csv_fields(line: Column | str, encoding: Column | str) -> Column:
    """The fields of a line of bytes; empty ones are NULL, a line without any character has none."""

    @F.pandas_udf("array<string>")
    def split(lines: pd.Series, encodings: pd.Series) -> pd.Series:
        out = []
        for line, encoding in zip(lines, encodings):
            text = line.decode(encoding, "replace").lstrip("\ufeff")
            out.append([f or None for f in next(csv.reader([text]), [])] if text else None)
        return pd.Series(out, dtype=object)

    return split(line, encoding)


def read_sensor_csv(
    spark: SparkSession, path: str, renames: dict[str, str] | None = None, time: str = "DATE", fmt: str | None = None,
) -> DataFrame:
    """SRC5: dirty sensor files of mixed encodings as ``(station, encoding, ts, indicator, raw)``.

    An encoding must decode a file to its end, which a first pass over the lines
    finds out; the second reads them.  Values stay text; cleaning decides what
    is a number.  The station is the file name.  Files may have any headers:
    each line meets that of its file, one row per file, of which there are fewer
    than the file listing that the driver holds anyway.  Fields beyond the
    header are dropped, missing ones are NULL; a file without ``time`` has NULL
    stamps.
    """
    lines = byte_lines(spark, path)
    files = stage(file_encodings(lines))
    if not files.head(1):
        raise FileNotFoundError(path)
    first = lines.groupBy("file").agg(F.min(F.struct("start", "id")).alias("_first"))
    known = F.broadcast(files.join(first, "file"))
    rows = lines.join(known, "file").where(F.struct("start", "id") != F.col("_first"))
    rows = rows.withColumn("_f", csv_fields("line", "encoding")).where(F.col("_f").isNotNull())
    names = F.map_from_entries(F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in (renames or {}).items()])) if renames else None
    column = F.col("_c._h")
    cells = rows.select(
        F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("station"), "encoding",
        F.get("_f", F.array_position("header", F.lit(time)).cast("int") - 1).alias("_time"),
        F.explode(F.transform("header", lambda h, i: F.struct(h.alias("_h"), F.get("_f", i).alias("_v")))).alias("_c"))
    stamp = F.col("_time").try_cast("timestamp_ntz") if fmt is None else parse_time("_time", fmt)
    return cells.where(F.coalesce(column, F.lit("")) != time).select(
        "station", "encoding", stamp.alias("ts"), (F.coalesce(names[column], column) if renames else column).alias("indicator"),
        F.col("_c._v").alias("raw"))


def read_timeseries_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: the first of the known time columns is parsed; bad stamps become NULL.

    Order is carried by that column; rows are sorted only where they are written.
    """
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    for name in TIME_COLUMNS:
        if name in df.columns:
            return df.withColumn(name, F.col(name).cast("string").try_cast("timestamp_ntz"))
    return df


def read_inference(spark: SparkSession, data: str | list, columns: int | None = None) -> DataFrame:
    """SRC7: headerless rows, the stamp first, as ``(ts, node, value)``; path or list."""
    if isinstance(data, str):
        wide = spark.read.csv(data)
    else:
        width = len(data[0])
        fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(width)]
        wide = spark.createDataFrame([tuple(None if x is None else str(x) for x in row) for row in data], T.StructType(fields))
    names = wide.columns[1:]
    if columns is not None and len(names) != columns:
        raise ValueError(f"shape mismatch: expected {columns} series, got {len(names)}")
    stamp = F.to_timestamp(F.col(wide.columns[0]), TIME_FORMAT).cast("timestamp_ntz")
    listed = [F.col(c).cast("float").alias(str(i)) for i, c in enumerate(names)]
    long = melt(wide.select(stamp.alias("ts"), *listed), ["ts"], [str(i) for i in range(len(names))], "node")
    return long.withColumn("node", F.col("node").cast("int"))


def read_classification(spark: SparkSession, folder: str, mode: str, archive: bool = False) -> DataFrame:
    """SRC9: ``(sample_id, features, label)``; archive sets have no validation part and use the test part."""
    if mode not in ("train", "valid", "test"):
        raise ValueError(f"unknown mode {mode}")
    part = "test" if archive and mode == "valid" else mode
    inputs = read_tensor(spark, f"{folder}/{part}_inputs.npy").select(
        F.col("t_idx").alias("sample_id"), F.struct("node", "channels").alias("_step"))
    features = inputs.groupBy("sample_id").agg(F.sort_array(F.collect_list("_step")).alias("_steps"))
    labels = read_tensor(spark, f"{folder}/{part}_labels.npy").select(
        F.col("t_idx").alias("sample_id"), F.get("channels", F.lit(0)).cast("int").alias("label"))
    return features.join(labels, "sample_id").select("sample_id", F.col("_steps.channels").alias("features"), "label")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: ``(src, dst, distance, line)``; the header and rows without three fields are skipped.

    ``line`` is the position in the file, files in order of their names, so that
    a later row can win.
    """
    rows = file_lines(spark, path).select("line", F.split("value", ",").alias("_f")).where(F.size("_f") == 3)
    out = rows.select(
        F.trim(F.col("_f")[0]).try_cast("long").alias("src"), F.trim(F.col("_f")[1]).try_cast("long").alias("dst"),
        F.trim(F.col("_f")[2]).try_cast("double").alias("distance"), "line")
    return out.where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def read_node_ids(spark: SparkSession, path: str) -> DataFrame:
    """The id file of GR1 as ``(id, position)``, positions in file order."""
    from chronoloom.operators.timeaxis import reindex

    lines = file_lines(spark, path).where(F.trim("value") != "").select(F.trim("value").cast("long").alias("id"), "line")
    return reindex(lines, [], "line", "position").select("id", "position")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """SRC11."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


METRIC_COLUMNS = ("feature string, count_less_5 double, count_less_10 double, samples_count double, per_less_5 double, "
                  "per_less_10 double, nse_val double, rmse_val double, nrmse_val double, r2_val double")


def read_metric_tables(spark: SparkSession, root: str, subfolder: str = "evaluation") -> DataFrame:
    """SRC12: every ``<model>/<subfolder>/<split>_metrics_unnorm.csv`` below ``root``.

    Model and split come from the path.  Nothing found gives an empty table.
    """
    empty = spark.createDataFrame([], f"model string, split string, {METRIC_COLUMNS}")
    try:
        df = (spark.read.option("header", True).schema(METRIC_COLUMNS).option("enforceSchema", False)
              .csv(f"{root}/*/{subfolder}/*_metrics_unnorm.csv"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    place = f"/([^/]+)/{subfolder}/(train|val|test)_metrics_unnorm[.]csv(/|$)"  # a file, or a folder of its parts
    path = F.input_file_name()
    return df.select(F.url_decode(F.regexp_extract(path, place, 1)).alias("model"), F.regexp_extract(path, place, 2).alias("split"),
                     *df.columns).where(F.col("split") != "")
