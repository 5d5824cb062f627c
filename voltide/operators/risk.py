"""Value at risk, expected shortfall and their tests, one row for each instrument."""

from __future__ import annotations

from math import exp, pi, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_day
from ..functions.tails import p_chi2


def normal_var_es(df: DataFrame, vol: str, alpha: float = 0.01) -> DataFrame:
    """df plus var, es (both positive) and hit, from an annualised volatility and normal innovations."""
    z = NormalDist().inv_cdf(alpha)
    daily = F.greatest(F.col(vol), F.lit(1e-10)) / sqrt(252)
    daily = F.when(F.col(vol).isNotNull(), daily)
    df = df.withColumns({"var": -daily * z, "es": daily * (exp(-z * z / 2) / sqrt(2 * pi) / alpha)})
    return df.withColumn("hit", F.coalesce((F.col("ret") < -F.abs("var")).cast("double"), F.lit(0.0)))


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def coverage(hits: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(ticker, n, x, lr_uc, lr_ind, lr_cc, p_cc, p_uc, p_ind): likelihood ratios in log space; null where the share of hits is 0 or 1."""
    prev = F.lag("hit").over(by_day())
    pairs = hits.where("var IS NOT NULL").withColumn("prev", prev)
    n = lambda a, b: F.sum(((F.col("prev") == a) & (F.col("hit") == b)).cast("double")).alias(f"n{a}{b}")
    t = pairs.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("hit").alias("x"), n(0, 0), n(0, 1), n(1, 0), n(1, 1))
    p = F.col("x") / F.col("n")
    uc = -2 * (_xlogy(F.col("n") - F.col("x"), (1 - F.lit(alpha)) / (1 - p)) + _xlogy(F.col("x"), F.lit(alpha) / p))
    n0, n1 = F.col("n00") + F.col("n01"), F.col("n10") + F.col("n11")
    p0, p1, q = F.col("n01") / F.nullif(n0, F.lit(0.0)), F.col("n11") / F.nullif(n1, F.lit(0.0)), (F.col("n01") + F.col("n11")) / F.nullif(n0 + n1, F.lit(0.0))
    alone = _xlogy(F.col("n00") + F.col("n10"), 1 - q) + _xlogy(F.col("n01") + F.col("n11"), q)
    split = _xlogy(F.col("n00"), 1 - p0) + _xlogy(F.col("n01"), p0) + _xlogy(F.col("n10"), 1 - p1) + _xlogy(F.col("n11"), p1)
    fine = (F.col("x") > 0) & (F.col("x") < F.col("n"))
    t = t.withColumns({"lr_uc": F.when(fine, uc), "lr_ind": F.when(fine & (q > 0) & (q < 1), -2 * (alone - split))})
    t = t.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
    return t.select("ticker", "n", F.col("x").cast("long").alias("x"), "lr_uc", "lr_ind", "lr_cc", F.exp(-F.col("lr_cc") / 2).alias("p_cc"), p_chi2(F.col("lr_uc"), 1).alias("p_uc"), p_chi2(F.col("lr_ind"), 1).alias("p_ind"))


def clustering(hits: DataFrame) -> DataFrame:
    """(ticker, n_violations, mean_run, max_run, mean_gap): runs of successive hits, by the difference of two numberings."""
    num = hits.withColumn("i", F.row_number().over(by_day())).where("hit = 1")
    num = num.withColumns({"k": F.row_number().over(by_day()), "gap": F.col("i") - F.lag("i").over(by_day())})
    runs = num.groupBy("ticker", (F.col("i") - F.col("k")).alias("g")).agg(F.count("*").alias("len"))
    gaps = num.groupBy("ticker").agg(F.count("*").alias("n_violations"), F.avg("gap").alias("mean_gap"))
    return gaps.join(runs.groupBy("ticker").agg(F.avg("len").alias("mean_run"), F.max("len").alias("max_run")), "ticker").select("ticker", "n_violations", "mean_run", "max_run", "mean_gap")


def _joint_score(alpha: float) -> Column:
    x, v, e = -F.col("ret"), F.col("var"), F.col("es")
    hit = (x >= v).cast("double")
    g = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), e)))
    return F.when(v.isNotNull(), (hit - alpha) * (v - F.least(x, v)) + g * hit * (x - v) / alpha + g * (e - v) - g)


def es_scores(hits: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(ticker, es_ratio, fz): mean loss over shortfall on violations (five at least), and the mean joint score."""
    ratio = F.when((F.col("hit") == 1) & (F.col("es") > 1e-10), -F.col("ret") / F.col("es"))
    score = _joint_score(alpha)
    return hits.groupBy("ticker").agg(F.when(F.count(ratio) >= 5, F.avg(ratio)).alias("es_ratio"), F.avg(score).alias("fz"))


def fissler_ziegel(hits: DataFrame, alpha: float = 0.01) -> DataFrame:
    """hits plus ``fz``, the joint score of each row."""
    return hits.withColumn("fz", _joint_score(alpha))


def dq(hits: DataFrame, alpha: float = 0.01, lags: int = 5) -> DataFrame:
    """(ticker, n, dq, p_dq): Wald test of hits less alpha on a constant, earlier hits and the size of the value at risk.

    Spark sums the products of the regressors; the equations of each instrument (seven unknowns) are solved from them.
    """
    by = by_day()
    k = lags + 2
    x = hits.withColumns({f"x{j}": F.lag("hit", j).over(by) for j in range(1, lags + 1)} | {"x0": F.lit(1.0), f"x{k - 1}": F.abs("var"), "y": F.col("hit") - alpha, "__n": F.count("*").over(Window.partitionBy("ticker"))})
    names = [f"x{j}" for j in range(k)]
    x = x.where(F.col("__n") >= lags + 20).na.drop(subset=[*names, "y"])
    both = [F.sum(F.col(a) * F.col(b)) for a in [*names, "y"] for b in [*names, "y"]]
    sums = x.groupBy("ticker").agg(F.count("*").alias("n"), F.array(*both).alias("m"))

    @F.pandas_udf("double")
    def wald(n: pd.Series, m: pd.Series) -> pd.Series:
        def one(n, m):
            m = np.array(m, float).reshape(k + 1, k + 1)
            xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
            if n < 30:
                return None
            beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
            noise = (yy - beta @ xy) / (n - k)
            singular = np.linalg.cond(xx) > 1e15
            return None if noise <= 0 or singular else float(beta @ xx @ beta / noise)

        return pd.Series([one(*r) for r in zip(n, m, strict=True)], dtype=float)

    out = sums.select("ticker", "n", wald("n", "m").alias("dq"))
    return out.withColumn("p_dq", p_chi2(F.col("dq"), k))


def report(hits: DataFrame, alpha: float = 0.01) -> DataFrame:
    """All tests and scores, a row for each instrument; missing run lengths and gaps are zero."""
    known = hits.where("var IS NOT NULL")
    parts = [clustering(known), es_scores(known, alpha), dq(hits, alpha).drop("n")]
    out = coverage(hits, alpha)
    for part in parts:
        out = out.join(part, "ticker", "left")
    return out.na.fill(0.0, ["mean_run", "mean_gap"]).na.fill(0, ["n_violations", "max_run"])


def pit_histogram(values: DataFrame, column: str = "pit", bins: int = 10) -> DataFrame:
    """(ticker, bin, n) on [0, 1], the last bin closed, empty bins too; nothing for fewer than ten values."""
    fine = values.where(F.col(column).between(0, 1))
    at = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("long")
    counts = fine.groupBy("ticker").agg(F.count("*").alias("total"), *(F.sum((at == k).cast("long")).alias(f"b{k}") for k in range(bins))).where("total >= 10")
    cells = F.array(*(F.struct(F.lit(k).cast("long").alias("bin"), F.col(f"b{k}").alias("n")) for k in range(bins)))
    return counts.select("ticker", F.explode(cells).alias("c")).select("ticker", "c.bin", "c.n")


def pit_uniform(histogram: DataFrame, bins: int = 10) -> DataFrame:
    """(ticker, chi2, p) against equal bins; null if fewer than five are expected in each."""
    total = F.sum("n")
    out = histogram.groupBy("ticker").agg(F.when(total / bins >= 5, F.sum(F.col("n") * F.col("n")) * bins / total - total).alias("chi2"))
    return out.withColumn("p", p_chi2(F.col("chi2"), bins - 1))


def standardized(df: DataFrame, vol: str) -> DataFrame:
    """(ticker, dt, z): returns over the daily volatility of an annualised forecast, where both are known."""
    return df.where(F.col(vol).isNotNull() & F.col("ret").isNotNull()).select("ticker", "dt", (F.col("ret") / F.greatest(F.col(vol) / sqrt(252), F.lit(1e-10))).alias("z"))


def fit_normal(residuals: DataFrame, least: int = 30) -> DataFrame:
    """(ticker, mu, sigma, n) of residuals below 20 in size; nothing for fewer than ``least``."""
    fine = residuals.where(~F.isnan("z") & (F.abs("z") < 20))
    return fine.groupBy("ticker").agg(F.avg("z").alias("mu"), (F.stddev_pop("z") + 1e-8).alias("sigma"), F.count("*").alias("n")).where(F.col("n") >= least)


def kupiec(hits: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(ticker, n, x, lr, p): the unconditional test, also for no hits."""
    t = hits.where("var IS NOT NULL").groupBy("ticker").agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("x"))
    p = F.col("x") / F.col("n")
    rest = F.col("n") - F.col("x")
    lr = F.when(F.col("x") == 0, -2 * F.col("n") * F.ln(F.lit(1 - alpha))).when(rest == 0, -2 * F.col("n") * F.ln(F.lit(alpha)))
    lr = lr.otherwise(-2 * (rest * F.ln((1 - F.lit(alpha)) / (1 - p)) + F.col("x") * F.ln(F.lit(alpha) / p)))
    return t.select("ticker", "n", "x", lr.alias("lr")).withColumn("p", p_chi2(F.col("lr"), 1))
