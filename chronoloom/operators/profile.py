"""Column profiles, quality reports and metric diagnosis (PR1-PR6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronoloom.functions.scalars import finite_or_null
from chronoloom.operators.quantiles import exact_quantiles
from chronoloom.operators.scalers import to_long, with_stats

# The percentiles a profile reports, and the limits of the diagnosis rules.
PERCENTILES = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
R2_LOW, R2_LOW_SHARE, NRMSE_HIGH, NEAR_SHARE = 0.5, 0.3, 0.5, 0.3


def numeric_columns(df: DataFrame, first: int | None = None) -> list[str]:
    """PRJ17: all of them, or the ``first`` where a caller asks for a limit."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return names[:first] if first else names


def _moments(v: Column) -> tuple[Column, Column]:
    """Bias-corrected skew and excess kurtosis from the population moments."""
    n = F.count(v).cast("double")
    flat = F.stddev_pop(v) == 0
    skew = F.when(n > 2, F.when(flat, 0.0).otherwise(
        F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))))
    shape = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    kurt = F.when(n > 3, F.when(flat, 0.0).otherwise(shape * ((n + 1) * F.kurtosis(v) + 6)))
    return skew, kurt


def summarize(long: DataFrame, keys: Sequence[str] = ("column",), value: str = "value") -> DataFrame:
    """PR1 on a long table: one row per group."""
    clean = long.withColumn(value, finite_or_null(value))
    v = F.col(value)
    skew, kurt = _moments(v)
    basics = clean.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.avg(v.isNull().cast("double")).alias("missing_ratio"),
        (F.count_if(v == 0) / F.count(F.lit(1))).alias("zero_ratio"), skew.alias("skew"), kurt.alias("kurt"))
    quantiles = exact_quantiles(clean, keys, value, list(PERCENTILES.values()), list(PERCENTILES))
    out = with_stats(basics, quantiles, keys)
    return out.select(*keys, "count", "mean", "std", "min", *PERCENTILES, "max", "missing_ratio", "zero_ratio",
                      "skew", "kurt")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """PR1 for the numeric columns of a wide table, all in the same jobs."""
    return summarize(to_long(df, [], columns or numeric_columns(df)))


def dataset_report(spark, sources: dict[str, str], reader) -> DataFrame:
    """PR2/SNK9: a row per dataset; an unreadable one carries its error instead.

    ``reader(path)`` returns a DataFrame.  Rows are counted on Spark; only
    schema facts stay on the driver.
    """
    schema = ("name string, path string, num_rows long, num_columns int, columns array<string>, "
              "numeric_columns array<string>, error string")
    parts = []
    for name, path in sources.items():
        try:
            df = reader(path)
        except Exception as e:  # noqa: BLE001
            text = "file not found" if "PATH_NOT_FOUND" in str(e) or isinstance(e, FileNotFoundError) else str(e)
            parts.append(spark.createDataFrame([(name, path, None, None, None, None, text)], schema))
            continue
        numeric = numeric_columns(df, None)
        parts.append(df.agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(name).alias("name"), F.lit(path).alias("path"), "num_rows", F.lit(len(df.columns)).alias("num_columns"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
            F.array(*[F.lit(c) for c in numeric]).cast("array<string>").alias("numeric_columns"),
            F.lit(None).cast("string").alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_report(long: DataFrame, config: DataFrame, keys: Sequence[str] = ("indicator",), value: str = "value") -> DataFrame:
    """PR3: long values against the configured physical range of their indicator.

    Indicators without any value are left out.
    """
    v = F.col(value)
    outside = (v < F.col("min_val")) | (v > F.col("max_val"))
    rows = long.join(config.select("indicator", "min_val", "max_val"), "indicator")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(v.isNull()).alias("missing"), F.count(v).alias("valid"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.count_if(outside).alias("out_of_range"))
    return out.where(F.col("valid") > 0).withColumn(
        "missing_pct", F.col("missing") / F.col("total") * 100).withColumn("in_range", F.col("out_of_range") == 0)


def retention(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PR4: rows kept per station, in percent; each side counts its distinct steps once."""
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"))
    out = b.join(a, list(keys), "left").withColumn("rows_after", F.coalesce("rows_after", F.lit(0)))
    return out.withColumn("retention_pct", F.col("rows_after") / F.col("rows_before") * 100)


def diagnose(tables: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    """PR5/PR6: the issues of each model and split, from its per-feature table.

    A rule whose column is absent is skipped.
    """
    have = set(tables.columns)
    aggs, rules = [], []
    if "r2_val" in have:
        aggs += [F.count_if(F.col("r2_val") < 0).alias("_neg"),
                 (F.count_if(F.col("r2_val") < R2_LOW) / F.count(F.lit(1))).alias("_low")]
        rules += [
            F.when(F.col("_neg") > 0, F.format_string("%d feature(s) r2<0 (worse-than-mean)", "_neg")),
            F.when(F.col("_low") > R2_LOW_SHARE, F.lit(">30% features r2<0.5 (weak generalization)")),
        ]
    if "nrmse_val" in have:
        aggs.append(F.max("nrmse_val").alias("_nrmse"))
        rules.append(F.when(F.col("_nrmse") > NRMSE_HIGH, F.lit("high nrmse on some features (>0.5)")))
    if "per_less_5" in have:
        aggs.append(F.avg("per_less_5").alias("_near"))
        rules.append(F.when(F.col("_near") < NEAR_SHARE, F.lit("low <5% relative error proportion (<0.3)")))
    if not aggs:
        empty = F.array(F.lit("metrics file empty or unreadable"))
        return tables.select(*by).distinct().withColumn("issues", empty)
    return tables.groupBy(*by).agg(*aggs).select(*by, F.array_compact(F.array(*rules)).alias("issues"))
