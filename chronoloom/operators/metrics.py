"""Masked forecast metrics (MET1-MET13).

Input is long: one row per element with ``prediction`` and ``target``, and
``sample_id, step, node, channel`` to say which.  A missing target never
counts.  A missing prediction for a valid target adds no error but counts in
the denominator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

# Tolerance around the sentinel, and the relative part of it that
# only some metrics apply.
EPS = 5e-5
RTOL = 1e-5


def valid(target: Column, null_val: float | None, rtol: bool) -> Column:
    """True where ``target`` is present and not the sentinel."""
    present = target.isNotNull() & ~F.isnan(target)
    if null_val is None or null_val != null_val:
        return present
    tol = EPS + (RTOL * abs(null_val) if rtol else 0.0)
    return present & (F.abs(target - F.lit(float(null_val))) > tol)


def _usable(c: str) -> Column:
    """NaN and infinities read as missing, so they cannot poison a sum."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


# Metrics of single elements: what an element adds, and which elements count.
# The metric is the sum over the count, so partial sums of any grouping add up.

def _absolute(p: Column, t: Column, null_val) -> tuple[Column, Column]:
    return F.abs(p - t), valid(t, null_val, False)


def _squared(p: Column, t: Column, null_val) -> tuple[Column, Column]:
    return (p - t) * (p - t), valid(t, null_val, True)


def _relative(p: Column, t: Column, null_val) -> tuple[Column, Column]:
    return F.abs((p - t) / F.nullif(t, F.lit(0.0))), valid(t, null_val, True) & (F.abs(t) > EPS)


def _symmetric(p: Column, t: Column, null_val) -> tuple[Column, Column]:
    size = (F.abs(p) + F.abs(t)) / 2
    return F.abs(p - t) / F.nullif(size, F.lit(0.0)), valid(t, null_val, True) & (F.abs(t) > EPS)


def _huber(p: Column, t: Column, null_val, delta: float = 1.0) -> tuple[Column, Column]:
    m = valid(t, null_val, True)
    e = F.abs(F.when(m, F.coalesce(p, F.lit(0.0)) - t).otherwise(F.lit(0.0)))
    return F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)), F.lit(True)


ELEMENTS: dict[str, Callable] = {
    "MAE": _absolute, "MSE": _squared, "RMSE": _squared, "MAPE": _relative, "SMAPE": _symmetric, "Huber": _huber,
}


def _sums(name: str, prediction: str, target: str, null_val: float | None) -> tuple[Column, Column]:
    error, mask = ELEMENTS[name](_usable(prediction), _usable(target), null_val)
    return F.sum(F.when(mask, F.coalesce(error, F.lit(0.0)))), F.count_if(mask)


def _ratio(name: str, total: Column, count: Column) -> Column:
    mean = F.coalesce(total / F.nullif(count, F.lit(0)), F.lit(0.0))
    return F.sqrt(mean) if name == "RMSE" else mean


def _aggregate(name: str, prediction: str, target: str, null_val: float | None) -> Column:
    return _ratio(name, *_sums(name, prediction, target, null_val))


def masked_mae(prediction: str = "prediction", target: str = "target", null_val: float | None = None) -> Column:
    """MET1."""
    return _aggregate("MAE", prediction, target, null_val)


def masked_mse(prediction: str = "prediction", target: str = "target", null_val: float | None = None) -> Column:
    """MET2."""
    return _aggregate("MSE", prediction, target, null_val)


def masked_rmse(prediction: str = "prediction", target: str = "target", null_val: float | None = None) -> Column:
    """MET3."""
    return _aggregate("RMSE", prediction, target, null_val)


def masked_mape(prediction: str = "prediction", target: str = "target", null_val: float | None = None) -> Column:
    """MET4: targets near zero are left out as well."""
    return _aggregate("MAPE", prediction, target, null_val)


def masked_smape(prediction: str = "prediction", target: str = "target", null_val: float | None = None) -> Column:
    """MET5."""
    return _aggregate("SMAPE", prediction, target, null_val)


def masked_huber(
    prediction: str = "prediction", target: str = "target", null_val: float | None = None,
    delta: float = 1.0, reduction: str = "mean",
) -> Column:
    """MET9: masked elements stay in the denominator with error 0; ``none`` gives the element losses."""
    loss, _ = _huber(_usable(prediction), _usable(target), null_val, delta)
    if reduction == "none":
        return loss
    return F.coalesce(F.sum(loss) if reduction == "sum" else F.avg(loss), F.lit(0.0))


def accuracy(prediction: str = "prediction", target: str = "target") -> Column:
    """MET10."""
    return F.avg((F.col(prediction) == F.col(target)).cast("double"))


# Metrics of a group of steps, averaged over groups.  Each has the aggregates of
# one group and the aggregate over groups.

def _zeroed(null_val: float | None) -> tuple[Column, Column, Column]:
    p, t = _usable("prediction"), _usable("target")
    m = valid(t, null_val, True)
    zero = F.lit(0.0)
    return m, F.when(m, F.coalesce(p, zero)).otherwise(zero), F.when(m, t).otherwise(zero)


def _wape_inner(null_val):
    _, p, t = _zeroed(null_val)
    return {"_wape": F.sum(F.abs(p - t)) / (F.sum(F.abs(t)) + EPS)}


def _r2_inner(null_val):
    p0, t0 = _usable("prediction"), _usable("target")
    m = valid(t0, null_val, False)
    zero = F.lit(0.0)
    p, t = F.when(m, F.coalesce(p0, zero)).otherwise(zero), F.when(m, t0).otherwise(zero)
    spread = F.var_pop(t) * F.count(F.lit(1))
    return {"_r2": 1 - F.sum((t - p) * (t - p)) / (spread + EPS)}


def _corr_inner(null_val):
    p, t = _usable("prediction"), _usable("target")
    whole = F.count_if(p.isNull() | t.isNull()) == 0
    spread = (F.var_pop(p) > 0) & (F.var_pop(t) > 0)
    return {
        "_corr": F.when(whole & spread, F.covar_pop(p, t) / F.sqrt(F.var_pop(p) * F.var_pop(t))).otherwise(0.0),
        "_corr_n": F.count_if(valid(t, null_val, False)),
    }


GROUP_METRICS: dict[str, tuple[Callable, Callable[[], Column]]] = {
    "WAPE": (_wape_inner, lambda: F.avg("_wape")),
    "R2": (_r2_inner, lambda: F.avg("_r2")),
    "CORR": (_corr_inner, lambda: F.coalesce(
        F.sum(F.col("_corr") * F.col("_corr_n")) / F.nullif(F.sum("_corr_n"), F.lit(0)), F.lit(0.0))),
}

METRICS = tuple(ELEMENTS) + tuple(GROUP_METRICS)
SKIPPED = ("MASE",)


def evaluate(
    df: DataFrame,
    metrics: Iterable[str | Callable[..., Column]] = METRICS,
    by: Sequence[str] = (),
    group: Sequence[str] = ("sample_id", "node", "channel"),
    null_val: float | None = None,
) -> DataFrame:
    """MET1-MET11: one row per ``by`` with one column per metric.

    A callable metric is called with ``null_val`` only where it takes that
    argument (MET11).  All named metrics come from one pass: where a grouped one
    is among them, the sums of the others travel through the same groups.  Every
    first stage combines map-side, so a hot ``by`` value is no hot task.
    """
    by = list(by)
    names, own = [], {}
    for m in metrics:
        if callable(m):
            name = getattr(m, "__name__", None) or getattr(m.func, "__name__")
            own[name] = _bind(m, null_val)
        elif m in SKIPPED:
            continue
        elif m in ELEMENTS or m in GROUP_METRICS:
            name = m
        else:
            raise ValueError(f"unknown metric {m}")
        names.append(name)
    element = [n for n in names if n in ELEMENTS and n not in own]
    grouped = [n for n in names if n in GROUP_METRICS and n not in own]
    parts = []
    if own or (element and not grouped):
        plain = {n: _aggregate(n, "prediction", "target", null_val) for n in element} if not grouped else {}
        parts.append(df.groupBy(*by).agg(*[c.alias(n) for n, c in {**own, **plain}.items()]))
    if grouped:
        inner: dict[str, Column] = {}
        for n in grouped:
            inner.update(GROUP_METRICS[n][0](null_val))
        for n in element:
            inner[f"_sum_{n}"], inner[f"_count_{n}"] = _sums(n, "prediction", "target", null_val)
        outer = {n: GROUP_METRICS[n][1]() for n in grouped}
        outer.update({n: _ratio(n, F.sum(f"_sum_{n}"), F.sum(f"_count_{n}")) for n in element})
        per_group = df.groupBy(*by, *group).agg(*[c.alias(n) for n, c in inner.items()])
        parts.append(per_group.groupBy(*by).agg(*[c.alias(n) for n, c in outer.items()]))
    if len(parts) == 1:
        return parts[0].select(*by, *names)
    if by:
        return parts[0].join(parts[1], by).select(*by, *names)
    tagged = [p.withColumn("_one", F.lit(1)) for p in parts]
    return tagged[0].join(tagged[1], "_one").select(*names)


def _pairs(prediction: str, target: str) -> Column:
    """The elements of a sample, NaN and infinities as missing."""
    usable = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return F.transform(F.arrays_zip(F.col(prediction).alias("p"), F.col(target).alias("t")), lambda z: F.struct(
        usable(z["p"].cast("double")).alias("p"), usable(z["t"].cast("double")).alias("t")))


def _fold(values: str, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, z: acc + F.coalesce(term(z).cast("double"), F.lit(0.0)))


def evaluate_samples(
    samples: DataFrame, metrics: Iterable[str] = METRICS, by: Sequence[str] = (), null_val: float | None = None,
    prediction: str = "prediction", target: str = "target",
) -> DataFrame:
    """MET1-MET9 straight from windows: one row per ``by``, as evaluate() gives for their elements.

    A row is one group of steps (a sample of one node and channel) with arrays.
    What a group contributes is folded inside its row, so nothing is exploded
    and only sums per ``by``, merged in each task first, are exchanged.
    """
    names = [m for m in metrics if m not in SKIPPED]
    unknown = [m for m in names if m not in ELEMENTS and m not in GROUP_METRICS]
    if unknown:
        raise ValueError(f"unknown metric {unknown[0]}")
    rows = samples.where(F.size(prediction) > 0).select(*by, _pairs(prediction, target).alias("_z"))
    mask = lambda z, rtol: valid(z["t"], null_val, rtol)
    zero = F.lit(0.0)

    def zeroed(rtol: bool) -> Column:
        return F.transform("_z", lambda z: F.struct(
            F.when(mask(z, rtol), F.coalesce(z["p"], zero)).otherwise(zero).alias("p"), F.when(mask(z, rtol), z["t"]).otherwise(zero).alias("t")))

    out, aggs = {}, {}
    for name in names:
        if name in ELEMENTS:
            part = ELEMENTS[name]
            rows = rows.withColumns({
                f"_sum_{name}": _fold("_z", lambda z, f=part: F.when(f(z["p"], z["t"], null_val)[1], f(z["p"], z["t"], null_val)[0])),
                f"_count_{name}": _fold("_z", lambda z, f=part: f(z["p"], z["t"], null_val)[1].cast("int"))})
            aggs |= {f"_sum_{name}": F.sum(f"_sum_{name}"), f"_count_{name}": F.sum(f"_count_{name}")}
            out[name] = _ratio(name, F.col(f"_sum_{name}"), F.col(f"_count_{name}"))
    if "WAPE" in names:
        rows = rows.withColumn("_m", zeroed(True)).withColumn(
            "_wape", _fold("_m", lambda z: F.abs(z["p"] - z["t"])) / (_fold("_m", lambda z: F.abs(z["t"])) + EPS))
        aggs["_wape"], out["WAPE"] = F.avg("_wape"), F.col("_wape")
    if "R2" in names:
        rows = rows.withColumn("_m", zeroed(False)).withColumn("_mean", _fold("_m", lambda z: z["t"]) / F.size("_m"))
        rows = rows.withColumn("_r2", 1 - _fold("_m", lambda z: (z["t"] - z["p"]) * (z["t"] - z["p"])) / (
            _fold("_m", lambda z: (z["t"] - F.col("_mean")) * (z["t"] - F.col("_mean"))) + EPS))
        aggs["_r2"], out["R2"] = F.avg("_r2"), F.col("_r2")
    if "CORR" in names:
        whole = ~F.exists("_z", lambda z: z["p"].isNull() | z["t"].isNull())
        varied = lambda c: F.array_max(F.col(f"_z.{c}")) > F.array_min(F.col(f"_z.{c}"))
        rows = rows.withColumns({"_mp": _fold("_z", lambda z: z["p"]) / F.size("_z"), "_mt": _fold("_z", lambda z: z["t"]) / F.size("_z")})
        of = lambda a, b: _fold("_z", lambda z: (z[a] - F.col(f"_m{a}")) * (z[b] - F.col(f"_m{b}")))
        rows = rows.withColumns({"_cov": of("p", "t"), "_vp": of("p", "p"), "_vt": of("t", "t"),
                                 "_corr_n": _fold("_z", lambda z: mask(z, False).cast("int"))})
        corr = F.when(whole & varied("p") & varied("t"), F.col("_cov") / F.sqrt(F.nullif(F.col("_vp") * F.col("_vt"), zero))).otherwise(0.0)
        rows = rows.withColumn("_corr", corr * F.col("_corr_n"))
        aggs |= {"_corr": F.sum("_corr"), "_corr_n": F.sum("_corr_n")}
        out["CORR"] = F.coalesce(F.col("_corr") / F.nullif(F.col("_corr_n"), zero), zero)
    sums = rows.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return sums.select(*by, *[out[n].alias(n) for n in names])


def _bind(metric: Callable[..., Column], null_val: float | None) -> Column:
    import inspect

    if "null_val" in inspect.signature(metric).parameters:
        return metric(null_val=null_val)
    return metric()


def named_metric(metric: Callable[..., Column], name: str | None = None, **kwargs) -> Callable[..., Column]:
    """A metric with bound arguments that keeps its name."""
    out = partial(metric, **kwargs)
    out.__name__ = name or metric.__name__
    return out


def long_metrics(wide: DataFrame, by: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """``(by, metric, value)`` rows."""
    return wide.unpivot(list(by), list(metrics), "metric", "value")


def horizon_metrics(
    df: DataFrame, horizons: Sequence[int], metrics: Sequence[str] = METRICS, by: Sequence[str] = (),
    null_val: float | None = None,
) -> DataFrame:
    """MET12: ``(by, scope, metric, value)`` for chosen 1-based steps and overall.

    At one horizon the grouped metrics run across nodes of a sample, since a
    group of steps would have a single element.  An element counts overall and,
    where its step is chosen, at its horizon; both come from the same pass.
    """
    by = list(by)
    overall = F.struct(F.lit("overall").alias("scope"), F.col("node").alias("_node"))
    chosen = F.col("step").isin([int(h) for h in horizons]) if horizons else F.lit(False)
    at = F.when(chosen, F.struct(
        F.concat(F.lit("horizon_"), F.col("step").cast("string")).alias("scope"), F.lit(None).cast(df.schema["node"].dataType).alias("_node")))
    rows = df.select(*by, "sample_id", "channel", "prediction", "target", F.inline(F.array_compact(F.array(overall, at))))
    names = [m for m in metrics if m not in SKIPPED]
    wide = evaluate(rows, names, [*by, "scope"], group=("sample_id", "_node", "channel"), null_val=null_val)
    return long_metrics(wide, [*by, "scope"], names)


def meter(values: DataFrame, by: Sequence[str], value: str = "value", weight: str = "n", squared: bool = False) -> DataFrame:
    """MET13: weighted running mean of batch values; RMSE averages squares."""
    v, n = F.col(value), F.col(weight)
    if squared:
        out = F.sqrt(F.sum(v * v * n) / F.nullif(F.sum(n), F.lit(0)))
    else:
        out = F.sum(v * n) / F.nullif(F.sum(n), F.lit(0))
    return values.groupBy(*by).agg(F.sum(weight).alias("n"), out.alias("value"))


def best_model(history: DataFrame, by: Sequence[str], metric: str, value: str, label: str,
               larger_is_better: Mapping[str, bool] | None = None) -> DataFrame:
    """SEL1: the best row per ``by`` and metric, in that metric's direction.

    Everything is minimised but accuracy.
    """
    larger = {"accuracy": True, **(larger_is_better or {})}
    up = [m for m, flag in larger.items() if flag]
    signed = F.when(F.col(metric).isin(up), -F.col(value)).otherwise(F.col(value))
    rank = F.struct(signed.alias("s"), F.col(label).alias("l"))
    clean = history.where(F.col(value).isNotNull() & ~F.isnan(value))
    return clean.groupBy(*by, metric).agg(
        F.min_by(label, rank).alias(label), F.min_by(value, rank).alias(value))
