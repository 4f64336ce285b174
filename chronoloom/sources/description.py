"""Dataset descriptions (SRC2, SRC3, SNK2, DS2)."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTINGS = ("STRUCT<INPUT_LEN: INT, OUTPUT_LEN: INT, TRAIN_VAL_TEST_RATIO: ARRAY<DOUBLE>, NORM_EACH_CHANNEL: BOOLEAN, "
             "RESCALE: BOOLEAN, METRICS: ARRAY<STRING>, NULL_VAL: DOUBLE>")
SCHEMA = (
    "name STRING, domain STRING, shape ARRAY<BIGINT>, num_time_steps BIGINT, num_nodes BIGINT, num_features INT, "
    "feature_description ARRAY<STRING>, has_graph BOOLEAN, `frequency (minutes)` DOUBLE, target_columns ARRAY<STRING>, "
    f"regular_settings {_SETTINGS}, settings {_SETTINGS}, _broken STRING")


def read_description(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """SRC2: ``<folder>/<name>/desc.json`` of the first folder that has it.

    A missing file raises ``FileNotFoundError``, an unreadable one ``ValueError``.
    """
    for folder in folders:
        path = f"{folder}/{name}/desc.json"
        try:
            df = (spark.read.schema(SCHEMA).option("multiLine", True).option("allowNonNumericNumbers", True)
                  .option("columnNameOfCorruptRecord", "_broken").json(path))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        row = df.select("_broken", "shape").first()
        if row is None or row["_broken"] is not None:
            raise ValueError(f"{path} is not valid JSON")
        out = df.drop("_broken").withColumn("regular_settings", F.coalesce("regular_settings", "settings"))
        return out.drop("settings")
    raise FileNotFoundError(f"no desc.json for {name} in {folders}")


def read_settings(spark: SparkSession, folders: list[str], name: str):
    """SRC3 from the file: the settings row; both key spellings are accepted."""
    row = read_description(spark, folders, name).select("regular_settings").first()[0]
    if row is None:
        raise KeyError(f"{name} has no settings")
    return row


def describe(
    series: DataFrame, name: str, domain: str, features: list[str], steps_per_day: float | None, has_graph: bool = False,
    settings: dict | None = None, node: str = "node", pos: str = "t_idx",
) -> DataFrame:
    """DS2: one row of counts and settings.

    The axis is dense from 0, so its length is one more than its largest step.
    Nodes are counted over all rows, as a node may begin after step 0.
    """
    counts = series.agg((F.max(pos) + 1).alias("n"), F.countDistinct(node).alias("num_nodes"))
    minutes = None if not steps_per_day else float(int(1440 // steps_per_day))
    given = F.from_json(F.lit(json.dumps(settings or {})), _SETTINGS, {"allowNonNumericNumbers": "true"})
    return counts.select(
        F.lit(name).alias("name"), F.lit(domain).alias("domain"),
        F.array(F.col("n"), F.col("num_nodes"), F.lit(len(features)).cast("long")).alias("shape"),
        F.col("n").alias("num_time_steps"), "num_nodes", F.lit(len(features)).alias("num_features"),
        F.array(*[F.lit(f) for f in features]).alias("feature_description"), F.lit(has_graph).alias("has_graph"),
        F.lit(minutes).cast("double").alias("frequency (minutes)"), given.alias("regular_settings"))


def write_description(description: DataFrame, path: str) -> None:
    """SNK2: one row, so one file."""
    description.coalesce(1).write.mode("overwrite").json(path)
