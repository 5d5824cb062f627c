"""Volatility estimators as column expressions over bars (ticker, dt, open, high, low, close, ret)."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import full

TRADING_DAYS = 252
FLOOR = 1e-12


def _log_ratio(a: str, b: str) -> Column:
    return F.ln(F.col(a) / F.nullif(F.col(b), F.lit(0.0)))


def parkinson() -> Column:
    return F.sqrt(F.pow(_log_ratio("high", "low"), 2) / (4 * log(2)))


def garman_klass() -> Column:
    v = 0.5 * F.pow(_log_ratio("high", "low"), 2) - (2 * log(2) - 1) / 2 * F.pow(_log_ratio("close", "open"), 2)
    return F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(FLOOR))))


def rogers_satchell() -> Column:
    v = _log_ratio("high", "close") * _log_ratio("high", "open") + _log_ratio("low", "close") * _log_ratio("low", "open")
    return F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(FLOOR))))


METHODS = {"parkinson": parkinson, "gk": garman_klass, "rs": rogers_satchell}


def realized_variance(window: int, ret: str = "ret") -> Column:
    return full(F.sum, F.col(ret) * F.col(ret), -(window - 1), 0)


def realized(window: int = 5, ret: str = "ret") -> Column:
    return F.sqrt(realized_variance(window, ret))


def range_based(window: int = 5, method: str = "parkinson") -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return F.sqrt(full(F.avg, F.pow(METHODS[method](), 2), -(window - 1), 0))


def forward_realized(horizon: int, ret: str = "ret", days: int = TRADING_DAYS) -> Column:
    """Annualised volatility of the next ``horizon`` rows; null in the last of a series."""
    return F.sqrt(full(F.sum, F.col(ret) * F.col(ret), 1, horizon)) * F.sqrt(F.lit(days / horizon))


def annualized(v: Column, days: int = TRADING_DAYS, horizon: int = 2) -> Column:
    return v * (days / horizon) ** 0.5
