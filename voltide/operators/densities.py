"""Densities of standardised residuals, one instrument (some thousand daily rows) a group, and forecasts drawn from them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.frames import forward_fill
from ..functions.volatility import TRADING_DAYS

#: What a fit is: parameters that a distribution lacks are null.
PARAMETERS = "dist string, mu double, sigma double, df double, shape double"
LEAST, LARGEST = 30, 20.0


class Normal:
    """Standard normal quantiles and probabilities, whatever was fitted (as the reference has it)."""

    def __init__(self, mu: float = 0.0, sigma: float = 1.0):
        self.row = ("normal", mu, sigma, None, None)

    @classmethod
    def fit(cls, z: np.ndarray) -> "Normal":
        return cls(float(z.mean()), float(z.std() + 1e-8))

    def cdf(self, z: np.ndarray) -> np.ndarray:
        return tails.normal_cdf(z)

    def shortfall(self, alpha: float) -> float:
        q = tails.quantile(tails.normal_cdf, alpha)
        return math.exp(-q * q / 2) / math.sqrt(2 * math.pi) / alpha


class Student(Normal):
    def __init__(self, df: float, mu: float, sigma: float):
        self.df, self.mu, self.sigma = df, mu, sigma
        self.row = ("studentt", mu, sigma, df, None)

    @classmethod
    def fit(cls, z: np.ndarray) -> "Student":
        def loss(p):
            scale = math.exp(p[1])
            return len(z) * p[1] - tails.t_log_pdf((z - p[0]) / scale, math.exp(p[2])).sum()

        start = np.array([np.median(z), math.log(np.std(z) * 0.8 + 1e-8), math.log(6.0)])
        mu, scale, df = min((tails.least(loss, start), tails.least(loss, start * [1, 1, 3])), key=loss)
        return cls(math.exp(min(df, 15)), float(mu), math.exp(scale))

    def cdf(self, z: np.ndarray) -> np.ndarray:
        return tails.t_cdf((z - self.mu) / self.sigma, self.df)

    def shortfall(self, alpha: float) -> float:
        x = tails.quantile(lambda z: tails.t_cdf(z, self.df), alpha)
        return math.exp(float(tails.t_log_pdf(np.array(x), self.df))) / alpha * (self.df + x * x) / (self.df - 1) * self.sigma - self.mu


class SkewNormal(Normal):
    def __init__(self, shape: float, mu: float, sigma: float):
        self.shape, self.mu, self.sigma = shape, mu, sigma
        self.row = ("skewt", mu, sigma, None, shape)

    @classmethod
    def fit(cls, z: np.ndarray) -> "SkewNormal":
        def loss(p):
            x = (z - p[0]) / math.exp(p[1])
            return len(z) * p[1] - (np.log(np.maximum(tails.normal_cdf(p[2] * x), 1e-300)) - x * x / 2).sum()

        spread = math.log(np.std(z) + 1e-8)
        mu, scale, shape = min((tails.least(loss, np.array([np.mean(z) - a * np.std(z) / 2, spread, a])) for a in (1.0, -1.0)), key=loss)
        return cls(float(shape), float(mu), math.exp(scale))

    def cdf(self, z: np.ndarray) -> np.ndarray:
        return tails.skew_normal_cdf((z - self.mu) / self.sigma, self.shape)


#: "skewt" is the reference's name of the skew normal; its shortfall is the normal one.
FITS = {"normal": Normal, "studentt": Student, "skewt": SkewNormal}


def fitted(z: np.ndarray, dist: str) -> Normal | None:
    z = z[np.isfinite(z) & (np.abs(z) < LARGEST)]
    return FITS[dist].fit(z) if len(z) >= LEAST else None


def fit(residuals: DataFrame, dist: str = "studentt") -> DataFrame:
    """(ticker, n, dist, mu, sigma, df, shape) of residuals(ticker, dt, z) below 20 in size; nothing for fewer than 30."""

    def run(t: pa.Table) -> pa.Table:
        z = t.column("z").to_numpy(zero_copy_only=False).astype(float)
        z = np.sort(z[np.isfinite(z) & (np.abs(z) < LARGEST)])
        rows = [(t.column("ticker")[0].as_py(), len(z), *fitted(z, dist).row)] if len(z) >= LEAST else []
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.float64()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["ticker", "n", "dist", "mu", "sigma", "df", "shape"])

    return residuals.select("ticker", "z").groupBy("ticker").applyInArrow(run, f"ticker string, n long, {PARAMETERS}")


def density_forecasts(df: DataFrame, vol: str, dist: str = "studentt", alpha: float = 0.01, compat_sign: bool = False) -> DataFrame:
    """(ticker, dt, ret, var, es, pit, dist) from an annualised forecast and the density of all its residuals.

    The forecast is filled forward. Too few residuals give the standard normal. Shortfalls are positive; ``compat_sign`` gives
    the reference's, negative but for "studentt".
    """
    daily = F.greatest(forward_fill(F.col(vol)), F.lit(1e-10)) / TRADING_DAYS**0.5
    known = df.withColumn("s", F.when(forward_fill(F.col(vol)).isNotNull(), daily)).select("ticker", "dt", "ret", "s")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("dt")
        s, r = (t.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("s", "ret"))
        z = r / s
        law = fitted(np.sort(z[np.isfinite(z)]), dist) or Normal()
        sign = -1 if compat_sign and dist != "studentt" else 1
        var, es, pit = -s * tails.quantile(law.cdf, alpha), sign * s * law.shortfall(alpha), np.full(len(z), np.nan)
        pit[np.isfinite(z)] = law.cdf(z[np.isfinite(z)])
        double = lambda x: pa.array(x, pa.float64(), from_pandas=True)
        return pa.table([t.column("ticker"), t.column("dt"), t.column("ret"), double(var), double(es), double(pit), pa.array([law.row[0]] * len(z))], names=["ticker", "dt", "ret", "var", "es", "pit", "dist"])

    made = known.groupBy("ticker").applyInArrow(run, "ticker string, dt date, ret double, var double, es double, pit double, dist string")
    return made.withColumn("hit", F.coalesce((F.col("ret") < -F.abs("var")).cast("double"), F.lit(0.0)))
