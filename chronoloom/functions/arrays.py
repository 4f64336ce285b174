"""Expressions over one window array (WIN3, WIN4, WIN7, WIN8)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EPS = 1e-5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def patches(window: Column | str, length: int, size: int, step: int) -> Column:
    """WIN3: sub-windows of ``size`` every ``step`` of a window of ``length``."""
    window = _col(window)
    starts = range(0, length - size + 1, step)
    return F.array(*[F.slice(window, s + 1, size) for s in starts])


def array_mean(window: Column | str) -> Column:
    window = _col(window)
    total = F.aggregate(window, F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))
    count = F.size(F.filter(window, lambda x: x.isNotNull()))
    return F.when(count > 0, total / count)


def array_var_pop(window: Column | str, mean: Column) -> Column:
    window = _col(window)
    total = F.aggregate(
        window, F.lit(0.0),
        lambda acc, x: acc + F.coalesce((x - mean) * (x - mean), F.lit(0.0)))
    count = F.size(F.filter(window, lambda x: x.isNotNull()))
    return F.when(count > 0, total / count)


def instance_stats(df, window: str, subtract_last: bool = False):
    """WIN7 statistics: adds ``centre`` and ``spread`` of each window."""
    df = df.withColumn("_mean", array_mean(window))
    centre = F.element_at(F.col(window), -1).cast("double") if subtract_last else F.col("_mean")
    return (
        df.withColumn("centre", centre)
        .withColumn("spread", F.sqrt(array_var_pop(window, F.col("_mean")) + F.lit(EPS)))
        .drop("_mean")
    )


def instance_norm(window: Column | str, weight: float = 1.0, bias: float = 0.0) -> Column:
    """WIN7 forward; needs ``centre`` and ``spread`` from :func:`instance_stats`."""
    return F.transform(
        _col(window),
        lambda x: (x - F.col("centre")) / F.col("spread") * F.lit(weight) + F.lit(bias))


def instance_denorm(window: Column | str, weight: float = 1.0, bias: float = 0.0) -> Column:
    """WIN7 inverse."""
    return F.transform(
        _col(window),
        lambda x: (x - F.lit(bias)) / F.lit(weight + EPS * EPS) * F.col("spread") + F.col("centre"))


def decoder_values(inputs: Column | str, in_len: int, out_len: int, start_len: int) -> Column:
    """WIN4 decoder input: the last ``start_len`` inputs, then zeros."""
    zeros = F.array_repeat(F.lit(0.0), out_len)
    if start_len == 0:
        return zeros
    return F.concat(F.slice(_col(inputs), in_len - start_len + 1, start_len).cast("array<double>"), zeros)


def decoder_marks(past: Column | str, future: Column | str, in_len: int, start_len: int) -> Column:
    """WIN4 decoder time features, shifted to [-0.5, 0.5)."""
    shifted = F.transform(_col(future), lambda x: x - 0.5)
    if start_len == 0:
        return shifted
    head = F.transform(F.slice(_col(past), in_len - start_len + 1, start_len), lambda x: x - 0.5)
    return F.concat(head, shifted)


def dft(window: Column | str, length: int) -> tuple[Column, Column]:
    """WIN8 as array expressions: real and imaginary parts of every frequency.

    The ``length`` x ``length`` twiddle factors are literals, so this suits the
    short windows of forecasting; :func:`chronoloom.operators.spectral.dft_long`
    covers long ones.
    """
    window = _col(window)

    def part(fn, sign: float) -> Column:
        rows = []
        for k in range(length):
            weights = F.array(*[F.lit(sign * fn(2.0 * math.pi * k * n / length)) for n in range(length)])
            rows.append(F.aggregate(
                F.zip_with(window, weights, lambda x, w: x * w),
                F.lit(0.0), lambda acc, x: acc + x))
        return F.array(*rows)

    return part(math.cos, 1.0), part(math.sin, -1.0)


def argmax(scores: Column | str) -> Column:
    """SCO4: 0-based position of the first largest score."""
    scores = _col(scores)
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
