"""Value cleaning and scalar transforms (PRJ8-PRJ16, MTH1)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_control(text: Column | str) -> Column:
    """PRJ8."""
    return F.regexp_replace(_col(text), r"[\x00-\x1F\x7F]", "")


def to_number(text: Column | str) -> Column:
    """PRJ9: unreadable text becomes NULL, and so does a spelled-out NaN."""
    number = _col(text).try_cast("double")
    return F.nullif(number, F.lit(float("nan")))


def positive_or_null(v: Column | str) -> Column:
    """PRJ10."""
    v = _col(v)
    return F.when(v > 0, v)


def in_range_or_null(v: Column | str, lo: Column, hi: Column) -> Column:
    """PRJ11."""
    v = _col(v)
    return F.when(v.between(lo, hi), v)


def clip(v: Column | str, lo: Column, hi: Column) -> Column:
    """PRJ12: missing stays missing, an open bound is NULL."""
    v = _col(v)
    return F.when(v < lo, lo).when(v > hi, hi).otherwise(v)


def round_to(v: Column | str, decimals: Column | int) -> Column:
    """PRJ13: half-even at a scale that may differ per row."""
    v = _col(v)
    if isinstance(decimals, int):
        return F.bround(v, decimals)
    scale = F.pow(F.lit(10.0), decimals)
    return F.rint(v * scale) / scale


def finite_or_zero(v: Column | str) -> Column:
    """PRJ14."""
    v = _col(v)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def finite_or_null(v: Column | str) -> Column:
    """PRJ16: both infinities and NaN become NULL."""
    v = _col(v)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def nan_or_inf_flags(v: Column | str) -> list[Column]:
    """PRJ15 as two aggregates: any NaN, any infinity."""
    v = _col(v)
    return [
        F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)).alias("has_nan"),
        F.coalesce(F.bool_or(F.abs(v) == float("inf")), F.lit(False)).alias("has_inf"),
    ]


def log1p_clamped(v: Column | str) -> Column:
    """MTH1: log(1 + max(v, 0))."""
    v = _col(v)
    return F.log1p(F.when(v < 0, F.lit(0.0)).otherwise(v))


def expm1(v: Column | str) -> Column:
    return F.expm1(_col(v))
