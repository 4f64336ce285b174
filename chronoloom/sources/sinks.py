"""Writers (SNK1, SNK3-SNK10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chronoloom.functions.calendar import TIME_FORMAT
from chronoloom.operators.evaluate import result_columns
from chronoloom.plans.forecasting import metric_record


def write_series(series: DataFrame, path: str, partition: Sequence[str] = ("dataset", "split"), node: str = "node",
                 pos: str = "t_idx", salt_steps: int = 1_000_000) -> None:
    """SNK1: Parquet by dataset and split, clustered by node and time.

    Rows are placed by node and by stretch of ``salt_steps``, so one long series
    is many writers; sorting inside makes the row groups prunable by time.
    """
    keys = [c for c in partition if c in series.columns]
    placed = series.repartition(*keys, F.col(node), F.floor(F.col(pos) / salt_steps))
    placed.sortWithinPartitions(*keys, node, pos).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_csv(df: DataFrame, path: str, float_format: str | None = "%.6f", header: bool = True, encoding: str = "UTF-8",
              order: Sequence[str] = ()) -> None:
    """SNK3: numbers in a fixed format; ``None`` writes them as they are."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if float_format and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c.isNotNull(), F.format_string(float_format, c.cast("double")))
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, TIME_FORMAT)
        columns.append(c.alias(f.name))
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    ordered.select(*columns).write.mode("overwrite").option("header", header).option("encoding", encoding).csv(path)


def write_transform_meta(meta: DataFrame, path: str) -> None:
    """SNK4: one JSON record per column with nested steps."""
    steps = [F.struct("q01", "q99").alias("winsor"), "log1p"]
    if "median" in meta.columns:
        steps.append(F.struct("median", "iqr").alias("robust"))
    if "min" in meta.columns:
        steps.append(F.struct("min", "max").alias("minmax"))
    rest = [c for c in meta.columns if c not in ("q01", "q99", "log1p", "median", "iqr", "min", "max")]
    meta.select(*rest, *steps).coalesce(1).write.mode("overwrite").json(path)


def read_transform_meta(spark: SparkSession, path: str) -> DataFrame:
    """The flat statistics of :func:`write_transform_meta`."""
    df = spark.read.json(path)
    flat = []
    for f in df.schema.fields:
        flat.append(f"{f.name}.*" if isinstance(f.dataType, T.StructType) else f.name)
    return df.select(*flat)


def write_forecast(forecast: DataFrame, path: str) -> None:
    """SNK5: the long forecast table by split."""
    forecast.write.mode("overwrite").partitionBy("split").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """SNK6: a nested JSON record per split."""
    metric_record(metrics).coalesce(1).write.mode("overwrite").json(path)


def write_future(forecast: DataFrame, path: str, nodes: Sequence, node: str = "node") -> None:
    """SNK7: a stamp and one column per node, without header.

    The file is as wide as the number of nodes, which the caller names.
    """
    wide = forecast.groupBy("ts").pivot(node, list(nodes)).agg(F.first("value"))
    write_csv(wide, path, None, header=False, order=["ts"])


def write_results(forecast: DataFrame, path: str, feature: str, features: Sequence, keys: Sequence[str] = ("sample_id", "step")) -> None:
    """SNK8: truth and prediction of every feature side by side."""
    wide = result_columns(forecast, keys, feature, features)
    placed = wide.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    placed.write.mode("overwrite").option("header", True).csv(path)


def write_dataset_report(report: DataFrame, path: str) -> None:
    """SNK9: a row per dataset; lists are joined with commas."""
    report.select(
        "name", "path", "num_rows", "num_columns", F.array_join("numeric_columns", ",").alias("numeric_columns"), "error",
    ).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_graph(spark: SparkSession, path: str, build) -> DataFrame:
    """SNK10: keeps an edge table that exists, else builds and writes it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)
