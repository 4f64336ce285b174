"""Per-feature evaluation tables and split evaluation (MET14-MET17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chronoloom.functions.scalars import finite_or_null
from chronoloom.session import stage

# Guard of the relative error, and its two thresholds.
GUARD = 1e-8
LIMITS = {"5": 0.05, "10": 0.10}


def relative_error(prediction: str, target: str, compat: bool = False) -> Column:
    """``compat`` keeps the sign of the truth, so negative truth always passes."""
    p, t = finite_or_null(F.col(prediction).cast("double")), finite_or_null(F.col(target).cast("double"))
    return F.abs(p - t) / ((t if compat else F.abs(t)) + F.lit(GUARD))


def _skill(residual: Column, spread: Column) -> Column:
    return 1 - residual / F.nullif(spread, F.lit(0.0))


def _scores(residual: Column, spread: Column, n: Column, lo: Column, hi: Column) -> dict[str, Column]:
    """NSE, RMSE, NRMSE and R2 from sums; a zero denominator gives NULL."""
    rmse = F.sqrt(residual / F.nullif(n, F.lit(0)))
    return {
        "nse_val": _skill(residual, spread), "rmse_val": rmse, "nrmse_val": rmse / F.nullif(hi - lo, F.lit(0.0)),
        "r2_val": _skill(residual, spread),
    }


def feature_table(
    df: DataFrame, feature: str, by: Sequence[str] = (), prediction: str = "prediction", target: str = "target",
    compat: bool = False,
) -> DataFrame:
    """MET14-MET16: one row per feature, then ``avg`` and ``all``.

    Elements without prediction or truth (NULL, NaN, infinite) count in ``samples_count`` only.  One
    pass takes the moments of each feature; that small table is written once,
    and ``avg`` and ``all`` are folded from it.
    """
    by = list(by)
    p = F.when(finite_or_null(F.col(target).cast("double")).isNotNull(), finite_or_null(F.col(prediction).cast("double")))
    t = F.when(finite_or_null(F.col(prediction).cast("double")).isNotNull(), finite_or_null(F.col(target).cast("double")))
    err = relative_error(prediction, target, compat)
    counts = [F.count_if(err < lim).alias(f"count_less_{k}") for k, lim in LIMITS.items()]
    moments = stage(df.groupBy(*by, F.col(feature).cast("string").alias("feature")).agg(
        *counts, F.count(F.lit(1)).alias("samples_count"), F.count(t).alias("_n"), F.sum((t - p) * (t - p)).alias("_res"),
        F.avg(t).alias("_mean"), (F.var_pop(t) * F.count(t)).alias("_spread"), F.min(t).alias("_lo"), F.max(t).alias("_hi")))
    own = _scores(*[F.col(c) for c in ("_res", "_spread", "_n", "_lo", "_hi")])
    per = moments.withColumns({
        **own, **{f"per_less_{k}": F.col(f"count_less_{k}") / F.col("samples_count") for k in LIMITS}})
    counted = ["count_less_5", "count_less_10"]
    shares = ["per_less_5", "per_less_10"]
    skills = ["nse_val", "rmse_val", "nrmse_val", "r2_val"]
    # squared distances around the common mean, from those around each feature's
    n, centre = F.sum("_n"), F.sum(F.col("_mean") * F.col("_n")) / F.nullif(F.sum("_n"), F.lit(0))
    apart = F.sum(F.col("_mean") * F.col("_mean") * F.col("_n")) - centre * centre * n
    pooled = _scores(F.sum("_res"), F.sum("_spread") + F.greatest(apart, F.lit(0.0)), n, F.min("_lo"), F.max("_hi"))
    folded = per.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in counted], F.max("samples_count").alias("samples_count"),
        *[F.avg(c).alias(c) for c in [*shares, *skills]], *[c.alias(f"_all_{k}") for k, c in pooled.items()])
    fields = [*counted, "samples_count", *shares]
    mean = folded.select(*by, F.lit("avg").alias("feature"), *fields, *skills)
    whole = folded.select(*by, F.lit("all").alias("feature"), *fields, *[F.col(f"_all_{k}").alias(k) for k in skills])
    return per.select(*by, "feature", *fields, *skills).unionByName(mean).unionByName(whole)


def result_columns(df: DataFrame, keys: Sequence[str], feature: str, features: Sequence[str]) -> DataFrame:
    """SNK8 layout: truth and ``_pred`` side by side, one column pair per feature."""
    wide = df.groupBy(*keys).pivot(feature, list(features)).agg(
        F.first("target").alias("truth"), F.first("prediction").alias("pred"))
    names = []
    for f in features:
        names += [F.col(f"`{f}_truth`").alias(str(f)), F.col(f"`{f}_pred`").alias(f"{f}_pred")]
    return wide.select(*keys, *names)
