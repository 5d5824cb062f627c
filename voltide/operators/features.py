"""The feature set of the regression models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_day, full
from ..functions.volatility import range_based, realized


def _skew(x):
    n, w = 20, by_day().rowsBetween(-19, 0)
    return F.when(F.count(x).over(w) == n, F.skewness(x).over(w) * (n * (n - 1)) ** 0.5 / (n - 2))


def _kurtosis(x):
    n, w = 20, by_day().rowsBetween(-19, 0)
    return F.when(F.count(x).over(w) == n, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6))


def build(bars: DataFrame) -> tuple[DataFrame, list[str]]:
    """Bars with returns plus up to 16 features, and their names; one shuffle, by instrument."""
    r = F.col("ret")
    made = {f"rolling_vol_{w}": realized(w) for w in (5, 10, 20, 63)}
    made |= {f"rolling_abs_{w}": full(F.avg, F.abs(r), 1 - w, 0) for w in (5, 10)}
    made |= {f"return_std_{w}": full(F.stddev_samp, r, 1 - w, 0) for w in (5, 20)}
    if {"high", "low"} <= set(bars.columns):
        made["range_vol_gk"] = range_based(5, "gk")
    made |= {"rv_d": F.abs(r), "rv_w": F.sqrt(full(F.avg, r * r, -4, 0)), "rv_m": F.sqrt(full(F.avg, r * r, -21, 0))}
    made |= {"rolling_skew_20": _skew(r), "rolling_kurt_20": _kurtosis(r)}
    top = F.max("close").over(by_day().rowsBetween(Window.unboundedPreceding, 0))
    made["drawdown"] = F.coalesce(F.col("close") / F.nullif(top, F.lit(0.0)) - 1, F.lit(0.0))
    out = bars.withColumns(made).withColumn("drawdown_5", full(F.min, F.col("drawdown"), -4, 0))
    return out, [*made, "drawdown_5"]
