"""Scoring of user models and the frequency-domain linear forecaster (SCO1-SCO4, MDL1, MDL3, MDL4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chronoloom.operators.skew import join_one
from chronoloom.session import stage

EPS = 1e-5
#: Samples that meet a model in one task.
SCORED = 50_000
Predict = Callable[[np.ndarray], np.ndarray]


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def _checked(out: np.ndarray, rows: int, out_len: int) -> np.ndarray:
    out = np.asarray(out, dtype=float)
    if out.shape != (rows, out_len):
        raise ValueError(f"model returned shape {out.shape}, expected {(rows, out_len)}")
    return out


def score(samples: DataFrame, predict: Predict, keys: Sequence[str], out_len: int, context: int | None = None,
          inputs: str = "inputs") -> DataFrame:
    """SCO1/SCO3: ``predict`` maps an array ``[rows, length]`` to ``[rows, out_len]``.

    Only keys and inputs reach the model, so it cannot see a target.
    ``context`` keeps the last steps of longer inputs.  One Arrow batch at a
    time; the result joins nothing back but carries ``target`` along.
    """
    extra = ["target"] if "target" in samples.columns else []
    schema = _fields(samples, [*keys, *extra]) + ", prediction array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf[inputs]])
            out = _checked(predict(x[:, -context:] if context else x), len(pdf), out_len)
            yield pdf[[*keys, *extra]].assign(prediction=list(out))

    return samples.select(*keys, *extra, inputs).mapInPandas(run, schema)


def score_jointly(samples: DataFrame, predict: Predict, sample: Sequence[str], out_len: int, node: str = "node",
                  inputs: str = "inputs") -> DataFrame:
    """SCO1 for models that look across nodes: ``[nodes, length]`` to ``[nodes, out_len]``.

    The nodes of one sample are one model input, so they meet in one row; it is
    as large as the model's own input and no larger.
    """
    packed = samples.groupBy(*sample).agg(
        F.sort_array(F.collect_list(F.struct(F.col(node).alias("node"), F.col(inputs).cast("array<double>").alias("x")))).alias("_list"))
    packed = packed.select(*sample, F.transform("_list", lambda r: r["node"]).alias("nodes"),
                           F.flatten(F.transform("_list", lambda r: r["x"])).alias("flat"))
    node_type = dict(samples.dtypes)[node]
    schema = _fields(samples, sample) + f", node {node_type}, prediction array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                n = len(r["nodes"])
                out = _checked(predict(np.asarray(r["flat"], dtype=float).reshape(n, -1)), n, out_len)
                part = pd.DataFrame({"node": r["nodes"], "prediction": list(out)})
                for c in sample:
                    part[c] = r[c]
                yield part[[*sample, "node", "prediction"]]

    return packed.mapInPandas(run, schema).withColumnRenamed("node", node)


@dataclass(frozen=True)
class FrequencyLinear:
    """A linear map between the spectra of a normalised window and its future."""

    weights: np.ndarray
    in_len: int
    out_len: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z, centre, spread = normalise(x)
        y = spectrum(z) @ self.weights
        half = self.out_len // 2 + 1
        wave = y[:, :half] + 1j * y[:, half:]
        return np.fft.irfft(wave, n=self.out_len, axis=1) * spread + centre


def normalise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre = x.mean(1, keepdims=True)
    spread = np.sqrt(x.var(1, keepdims=True) + EPS)
    return (x - centre) / spread, centre, spread


def spectrum(z: np.ndarray) -> np.ndarray:
    f = np.fft.rfft(z, axis=1)
    return np.hstack([f.real, f.imag])


def frequency_moments(samples: DataFrame, in_len: int, out_len: int, by: str | None = None) -> DataFrame:
    """The normal equations of MDL1, one row per equation.

    Each task folds its samples into one small matrix; the matrices are added
    in two steps, so no task adds more than a slice of the partitions.
    Samples with a missing value are left out.
    """
    whole = ~F.exists("inputs", lambda v: v.isNull()) & ~F.exists("target", lambda v: v.isNull())
    group = F.col(by).cast("string") if by else F.lit("")
    rows = samples.where(whole).select(group.alias("dataset"), "inputs", "target")
    p = 2 * (in_len // 2 + 1)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, part in pdf.groupby("dataset", sort=False):
                x = np.stack([np.asarray(v, dtype=float) for v in part["inputs"]])
                y = np.stack([np.asarray(v, dtype=float) for v in part["target"]])
                z, centre, spread = normalise(x)
                a, b = spectrum(z), spectrum((y - centre) / spread)
                acc[name] = acc.get(name, 0.0) + a.T @ np.hstack([a, b])
        for name, m in acc.items():
            yield pd.DataFrame({"dataset": name, "i": np.arange(p), "row": list(m)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["row"].to_numpy()), axis=0)
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "i": [pdf["i"].iloc[0]], "row": [total]})

    schema = "dataset string, i long, row array<double>"
    parts = rows.mapInPandas(fold, schema).withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(64)))
    partial = parts.groupBy("dataset", "i", "_slice").applyInPandas(add, schema)
    return partial.groupBy("dataset", "i").applyInPandas(add, schema)


def frequency_models(moments: DataFrame, in_len: int, out_len: int, ridge: float) -> DataFrame:
    """(dataset, weights): the small solve of each dataset in a task of its own; its size is the window's, not the data's."""
    p = 2 * (in_len // 2 + 1)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf.sort_values("i")["row"].to_numpy())
        weights = np.linalg.solve(m[:, :p] + ridge * np.eye(p), m[:, p:])
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "weights": [weights.ravel()]})

    return moments.groupBy("dataset").applyInPandas(solve, "dataset string, weights array<double>")


def frequency_model(weights: Sequence[float], in_len: int, out_len: int) -> FrequencyLinear:
    return FrequencyLinear(np.asarray(weights, float).reshape(2 * (in_len // 2 + 1), -1), in_len, out_len)


def fit_frequency_linear(samples: DataFrame, in_len: int, out_len: int, ridge: float = 1.0) -> FrequencyLinear:
    """MDL1: one pass over the samples; only the weights, of the window's size, reach the driver."""
    found = frequency_models(frequency_moments(samples, in_len, out_len), in_len, out_len, ridge).first()
    if found is None:
        raise ValueError("no sample without a missing value")
    return frequency_model(found["weights"], in_len, out_len)


def fit_per_dataset(samples: DataFrame, by: str, in_len: int, out_len: int, ridge: float = 1.0) -> DataFrame:
    """MDL4: a table of models (dataset, weights), all fitted in the same pass; nothing per dataset reaches the driver."""
    return frequency_models(frequency_moments(samples, in_len, out_len, by), in_len, out_len, ridge)


def score_per_dataset(samples: DataFrame, models: DataFrame, by: str, keys: Sequence[str], in_len: int, out_len: int,
                      block: int = SCORED) -> DataFrame:
    """Each sample by the model of its dataset; a dataset without a model is an error.

    Samples of a dataset are dealt to blocks of about ``block``, and its model
    goes to each of them.
    """
    rows = samples.select(F.col(by).cast("string").alias("_of"), by, *keys, "target", "inputs")
    blocks = rows.groupBy("_of").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    shared = blocks.join(models.withColumnRenamed("dataset", "_of"), "_of", "left").select(
        F.col("_of").alias("_for"), "weights", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_part"))
    dealt = join_one(rows, stage(blocks.withColumn("_n", F.col("_blocks") * block)), ["_of"], "_n", rows_each=block).drop("_n")
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(by, *keys), F.col("_blocks"))).drop("_blocks")
    schema = _fields(samples, [by, *keys, "target"]) + ", prediction array<double>"

    def run(part: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return part[[by, *keys, "target"]].assign(prediction=[])
        if model["weights"].isna().any():
            raise KeyError(f"no model for {part['_of'].iloc[0]}")
        x = np.stack([np.asarray(v, dtype=float) for v in part["inputs"]])
        out = _checked(frequency_model(model["weights"].iloc[0], in_len, out_len)(x), len(part), out_len)
        return part[[by, *keys, "target"]].assign(prediction=list(out))

    return dealt.groupBy("_of", "_block").cogroup(shared.groupBy("_for", "_part")).applyInPandas(run, schema)


LOSSES = {"MAE": np.abs, "MSE": np.square, "RMSE": np.square}


def grid_search(samples: DataFrame, grid: DataFrame, predict: Callable[..., np.ndarray], out_len: int, metric: str = "MAE",
                inputs: str = "inputs", target: str = "target") -> DataFrame:
    """MDL3: the error of every combination of ``grid`` over the same samples, in one job and one scan.

    ``grid`` is a table of parameters with a column ``combination`` (see
    parameter_grid()); ``predict`` takes an array ``[rows, length]``, missing
    values as NaN, and the parameters by name, and gives ``[rows, out_len]``.
    Tasks add up errors per combination.  One that fails anywhere has its error
    as a row and no metric.  Missing targets do not count, missing predictions
    have no error.
    """
    names = [c for c in grid.columns if c != "combination"]
    tried = [(r["combination"], {c: r[c] for c in names}) for r in grid.collect()]
    loss = LOSSES[metric]
    matrix = lambda column: np.array([[np.nan if x is None else x for x in v] for v in column], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count, failed = {}, {}, {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = matrix(pdf[inputs]), matrix(pdf[target])
            for k, params in tried:
                if k in failed:
                    continue
                try:
                    error = loss(_checked(predict(x, **params), len(x), out_len) - y)
                except Exception as e:  # noqa: BLE001
                    failed[k] = f"{type(e).__name__}: {e}"
                    continue
                total[k] = total.get(k, 0.0) + float(np.nansum(error))
                count[k] = count.get(k, 0) + int((~np.isnan(y)).sum())
        yield pd.DataFrame({"combination": [k for k, _ in tried], "total": [total.get(k, 0.0) for k, _ in tried],
                            "count": [count.get(k, 0) for k, _ in tried], "error": [failed.get(k) for k, _ in tried]})

    sums = samples.select(inputs, target).mapInPandas(run, "combination long, total double, count long, error string")
    found = sums.groupBy("combination").agg(F.sum("total").alias("total"), F.sum("count").alias("count"), F.min("error").alias("error"))
    mean = F.col("total") / F.nullif(F.col("count"), F.lit(0))
    value = F.when(F.col("error").isNull(), F.sqrt(mean) if metric == "RMSE" else mean)
    return grid.join(found.select("combination", value.alias("metric"), "error"), "combination", "left")


def rank_grid(results: DataFrame, metric: str = "metric", top: int = 10) -> DataFrame:
    """TOP1: the best combinations, ascending; failures are never ranked."""
    return results.where(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(metric, "combination").limit(top)


def failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("error").isNotNull())
