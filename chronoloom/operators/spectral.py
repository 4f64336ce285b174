"""Fourier transforms of windows (WIN8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from chronoloom.functions import arrays

SHORT = 32


def with_dft(samples: DataFrame, column: str, length: int, real: str = "re", imag: str = "im") -> DataFrame:
    """Real and imaginary parts of each window's transform.

    Short windows stay in array expressions, long ones go through one
    vectorised FFT per Arrow batch.
    """
    if length <= SHORT:
        re, im = arrays.dft(column, length)
        return samples.withColumn(real, re).withColumn(imag, im)
    return dft_long(samples, column, length, real, imag)


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + extra


def _windows(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Windows as a matrix, and which of them are whole; the others are zeros."""
    rows = [np.array([np.nan if x is None else x for x in v] if v is not None else [], float) for v in column]
    whole = np.array([len(r) > 0 and not np.isnan(r).any() for r in rows])
    width = max(map(len, rows))
    return np.array([r if ok else np.zeros(width) for r, ok in zip(rows, whole)]), whole


def _lists(made: np.ndarray, whole: np.ndarray) -> list:
    """One list per window; a window with a missing value has missing values only."""
    return [list(m) if ok else [None] * made.shape[1] for m, ok in zip(made, whole)]


def dft_long(samples: DataFrame, column: str, length: int, real: str = "re", imag: str = "im") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, whole = _windows(pdf[column])
                spectrum = np.fft.fft(x, axis=1)
                yield pdf.assign(**{real: _lists(spectrum.real, whole), imag: _lists(spectrum.imag, whole)})

    return samples.mapInPandas(run, _schema(samples, f"`{real}` array<double>, `{imag}` array<double>"))


def inverse_dft(samples: DataFrame, real: str, imag: str, name: str) -> DataFrame:
    """The real part of the inverse transform; a spectrum with a missing value gives missing values."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                (x, a), (y, b) = _windows(pdf[real]), _windows(pdf[imag])
                yield pdf.assign(**{name: _lists(np.fft.ifft(x + 1j * y, axis=1).real, a & b)})

    return samples.mapInPandas(run, _schema(samples, f"`{name}` array<double>"))
