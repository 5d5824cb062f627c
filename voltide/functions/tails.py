"""Tail probabilities and distributions: as Arrow functions of columns (one row an instrument, mostly), and as plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def erfc(x: np.ndarray) -> np.ndarray:
    """On whole arrays: the power series under 2, the continued fraction from there on; nan stays nan."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 30.0)  # erfc(30) is 0 in double precision
    small = np.minimum(a, 2.0)
    term = total = small
    for n in range(1, 60):
        term = term * (2 * small * small / (2 * n + 1))
        total = total + term
    large = np.maximum(a, 2.0)
    below = large
    for n in range(100, 0, -1):
        below = large + n / 2 / below
    tail = np.where(a < 2, 1 - 2 / math.sqrt(math.pi) * np.exp(-small * small) * total, np.exp(-large * large) / (math.sqrt(math.pi) * below))
    return np.where(np.isnan(x), np.nan, np.where(x < 0, 2 - tail, tail))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(z, float) / math.sqrt(2))


def chi2_tail(x: np.ndarray, k: int) -> np.ndarray:
    """P(X > x) of a chi-square variable with k degrees of freedom, from the finite sums for whole k."""
    x = np.asarray(x, float)
    half = x / 2
    if k % 2 == 0:
        term = total = np.ones_like(x)
        for j in range(1, k // 2):
            term = term * half / j
            total = total + term
        return np.exp(-half) * total
    term, total = np.sqrt(2 * x / math.pi) * np.exp(-half), np.zeros_like(x)
    for j in range(1, (k - 1) // 2 + 1):
        total = total + term
        term = term * x / (2 * j + 1)
    return erfc(np.sqrt(half)) + total


def _on_known(x: pd.Series, f) -> pd.Series:
    """f of what is known; the rest stays missing, which Spark reads as null."""
    out, known = np.full(len(x), np.nan), x.notna().to_numpy()
    out[known] = f(x.to_numpy(float)[known])
    return pd.Series(out)


def p_normal(z: Column) -> Column:
    """Two-sided p of a standard normal statistic; null for null."""

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return _on_known(z, lambda v: erfc(np.abs(v) / math.sqrt(2)))

    return p(z)


def p_chi2(x: Column, k: int) -> Column:
    """Upper p of a chi-square statistic; null for null."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return _on_known(x, lambda v: chi2_tail(np.maximum(v, 0), k))

    return p(x)


def t_log_pdf(z: np.ndarray, df: float) -> np.ndarray:
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - (df + 1) / 2 * np.log1p(z * z / df)


def t_cdf(z: np.ndarray, df: float) -> np.ndarray:
    """By the continued fraction of the incomplete beta function."""
    z = np.asarray(z, float)
    x = df / (df + z * z)
    tail = 0.5 * _beta(x, df / 2, 0.5)
    return np.where(z > 0, 1 - tail, tail)


def _beta(x: np.ndarray, a: float, b: float) -> np.ndarray:
    flip = x > (a + 1) / (a + b + 2)
    one = np.where(flip, _fraction(np.where(flip, 1 - x, 0.0), b, a), 0.0)
    two = np.where(flip, 0.0, _fraction(np.where(flip, 0.0, x), a, b))
    return np.where(flip, 1 - one, two)


def _fraction(x: np.ndarray, a: float, b: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    value = np.ones_like(x)
    for m in range(200, 0, -1):  # backwards, so that no guard against zero is needed
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + even / (1 + odd / value)
    return front / (1 - (a + b) * x / (a + 1) / value)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def skew_normal_cdf(z: np.ndarray, shape: float) -> np.ndarray:
    """Normal cdf less twice Owen's T, integrated over the angle."""
    z = np.asarray(z, float)
    top = math.atan(shape)
    angle = (_NODES + 1) / 2 * top
    owen = (np.exp(-np.multiply.outer(z * z, 0.5 / np.cos(angle) ** 2)) @ _WEIGHTS) * top / 2 / (2 * math.pi)
    return normal_cdf(z) - 2 * owen


def quantile(cdf, p: float, low: float = -200.0, high: float = 200.0) -> float:
    """By bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(cdf(np.array([mid]))[0]) < p else (low, mid)
    return (low + high) / 2


def least(f, start: np.ndarray, scale: float = 0.2, rounds: int = 400, close: float = 1e-10) -> np.ndarray:
    """A minimum of f by a downhill simplex."""
    n = len(start)
    points = np.vstack([start, start + scale * np.eye(n)])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if values[-1] - values[0] < close * (1 + abs(values[0])):
            break
        centre = points[:-1].mean(axis=0)
        along = lambda k: centre + k * (centre - points[-1])  # noqa: E731, B023
        trial = along(1.0)
        value = f(trial)
        if value < values[0]:
            further = along(2.0)
            v = f(further)
            trial, value = (further, v) if v < value else (trial, value)
        elif value >= values[-2]:
            trial = along(0.5 if value < values[-1] else -0.5)
            value = f(trial)
            if value >= values[-1]:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = trial, value
    return points[int(np.argmin(values))]
