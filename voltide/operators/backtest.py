"""Volatility targeting: the path and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_day, back_fill, clip, forward_fill, full


def _so_far():
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def volatility_target(df: DataFrame, vol: str, target: float = 0.10, most: float = 3.0, least: float = 0.0, cost_bps: float = 0.0, slippage_bps: float = 0.0) -> DataFrame:
    """Leverage is target over forecast (filled forward, then back), applied a row later; costs by turnover and by size.

    The path begins with the first row that has a leverage from before and a return; rows without either are no part of it.
    """
    df = df.withColumn("__v", clip(F.coalesce(forward_fill(F.col(vol)), back_fill(F.col(vol))), 1e-8))
    df = df.withColumn("leverage", clip(target / F.col("__v"), least, most))
    df = df.withColumn("__l", F.lag("leverage").over(by_day()))
    df = df.withColumns({"scaled": F.col("__l") * F.col("ret"), "turnover": F.coalesce(F.abs(F.col("__l") - F.lag("__l").over(by_day())), F.lit(0.0))}).where("scaled IS NOT NULL")
    df = df.withColumn("costs", F.col("turnover") * cost_bps / 1e4 + F.abs("scaled") * slippage_bps / 1e4)
    df = df.withColumn("net", F.col("scaled") - F.col("costs"))
    df = df.withColumns({"cum": F.product(1 + F.col("net")).over(_so_far()), "realized_vol_ann": F.sqrt(full(F.avg, F.col("scaled") * F.col("scaled"), -21, 0)) * 252**0.5})
    return df.withColumn("drawdown", F.col("cum") / F.max("cum").over(_so_far()) - 1).drop("__v", "__l")


def summary(path: DataFrame, target: float = 0.10, aversion: float = 2.0, free: float = 0.0) -> DataFrame:
    path = path.withColumn("__t", F.abs(F.col("leverage") - F.lag("leverage").over(by_day())))
    out = path.groupBy("ticker").agg(F.avg("net").alias("m"), F.stddev_samp("net").alias("s"), F.min("drawdown").alias("max_dd"), F.avg("__t").alias("turnover"), F.count("net").alias("n"))
    out = out.withColumns({
        "sharpe": (F.col("m") - free / 252) / (F.col("s") + 1e-12) * 252**0.5,
        "mean_ret": F.col("m") * 252,
        "realized_vol": F.when(F.col("n") > 21, F.col("s") * 252**0.5),
        "utility": F.col("m") * 252 - aversion / 2 * F.col("s") * F.col("s") * 252,
    })
    return out.withColumn("vol_error", F.abs(F.col("realized_vol") - target)).select("ticker", "sharpe", "max_dd", "mean_ret", "turnover", "realized_vol", "utility", "vol_error")
