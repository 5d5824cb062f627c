"""Walk-forward volatility forecasts: a forecast stamped t uses what was known before t, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import by_day, forward_fill, full
from ..functions.volatility import TRADING_DAYS
from .recurrences import recurrence
from .walks import on_rows, walk


def naive(v: str, horizon: int = 1) -> Column:
    return F.lag(v, horizon).over(by_day())


def rolling_mean(v: str, window: int = 22, horizon: int = 1) -> Column:
    return full(F.avg, F.col(v), -(window - 1 + horizon), -horizon)


def har(bars: DataFrame, window: int = 252, least: int = 50, ret: str = "ret", step: int = 1) -> DataFrame:
    """bars plus ``har_rv``: rolling least squares without intercept of daily, weekly and monthly volatility, one row ahead.

    The normal equations are window sums of products of neighbouring rows, solved by Cramer's rule in columns; where they are
    singular to working precision there is no forecast (the one before is filled forward). Every ``step``-th row is forecast.
    """
    r = F.col(ret)
    x = ["__d", "__w", "__m"]
    df = bars.withColumns({"__d": F.abs(r), "__w": F.sqrt(full(F.avg, r * r, -4, 0)), "__m": F.sqrt(full(F.avg, r * r, -21, 0)), "__n": F.row_number().over(by_day())})
    df = df.withColumns({f"{c}1": F.lag(c).over(by_day()) for c in x})
    ok = F.col("__m1").isNotNull()
    train = by_day().rowsBetween(-(window - 1), -1)
    moment = lambda a, b: F.sum(F.when(ok, F.col(a) * F.col(b))).over(train)
    pairs = {f"__s{i}{j}": moment(f"{x[i]}1", f"{x[j]}1") for i in range(3) for j in range(i, 3)} | {f"__y{i}": moment(f"{x[i]}1", "__d") for i in range(3)}
    df = df.withColumns(pairs | {"__k": F.count(F.when(ok, F.lit(1))).over(train)})
    a = lambda i, j: F.col(f"__s{min(i, j)}{max(i, j)}")

    def det(m):
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    base = det([[a(i, j) for j in range(3)] for i in range(3)])
    base = F.when(F.abs(base) > 1e-14 * a(0, 0) * a(1, 1) * a(2, 2), base)
    beta = [det([[F.col(f"__y{i}") if j == c else a(i, j) for j in range(3)] for i in range(3)]) / base for c in range(3)]
    value = sum((beta[c] * F.col(f"{x[c]}1") for c in range(1, 3)), beta[0] * F.col("__d1"))
    value = F.when((F.col("__n") > window + 22) & ((F.col("__n") - window - 23) % step == 0) & (F.col("__k") >= least) & value.isNotNull(), F.greatest(value, F.lit(1e-8)))
    return df.withColumn("har_rv", forward_fill(value)).drop(*(c for c in df.columns if c.startswith("__")))


def ewma(bars: DataFrame, decay: float = 0.94, burn_in: int = 20, ret: str = "ret") -> DataFrame:
    """(ticker, dt, ewma): exponentially weighted volatility, annualised; null before the burn-in ends."""
    r = F.col(ret)
    v = recurrence(bars.select("ticker", "dt", ret), ["ticker"], (1 - decay) * r * r, decay, burn_in, F.var_samp(r))
    return v.select("ticker", "dt", F.sqrt(F.col("value") * TRADING_DAYS).alias("ewma"))


def gas(bars: DataFrame, window: int = 252, omega: float = 0.01, alpha: float = 0.08, beta: float = 0.90, ret: str = "ret") -> DataFrame:
    """(ticker, dt, gas): score-driven variance with fixed parameters, beta >= alpha, annualised; never under 1e-12."""
    r = F.col(ret)
    v = recurrence(bars.select("ticker", "dt", ret), ["ticker"], omega + alpha * r * r, beta - alpha, window, F.avg(r * r), 1e-12)
    return v.select("ticker", "dt", F.sqrt(F.col("value") * TRADING_DAYS).alias("gas"))


def refits(x: np.ndarray, own: np.ndarray, window: int, least: int, fit: Callable[[np.ndarray, np.ndarray], Callable]) -> tuple[list[int], list[float]]:
    """Rows and forecasts of a regression refitted at each of the rows ``own``; the last column is the target. Only complete rows train and are forecast."""
    fine = np.isfinite(x[:, :-1]).all(axis=1)
    whole, at, value = fine & np.isfinite(x[:, -1]), [], []
    for t in own:
        use = np.flatnonzero(whole[t - window : t]) + t - window
        if fine[t] and len(use) >= least:
            at.append(t)
            value.append(fit(x[use, :-1], x[use, -1])(x[t, :-1]))
    return at, value


def ridge(data: DataFrame, features: list[str], target: str, window: int = 1260, step: int = 2, alpha: float = 1.0, least: int = 200, isolate: bool = False) -> DataFrame:
    """(ticker, dt, ridge): standardised ridge regression refitted every ``step`` rows on the ``window`` rows before, at row t on the features of t.

    At least 0, filled forward. With ``isolate`` what ``walk`` gives.
    """

    def run(x, own):
        at, value = refits(x, own, window, least, lambda z, y: _regression(z, y, alpha))
        return at, np.maximum(value, 0.0)

    made = walk(data, "ridge", [*features, target], run, lambda n: np.arange(window, n, step), isolate=isolate)
    return made if isolate else on_rows(data, made, "ridge")


def _regression(z: np.ndarray, y: np.ndarray, alpha: float, scaled: bool = True):
    """A ridge regression with intercept, of standardised columns or of columns as they are."""
    mean, scale = z.mean(axis=0), z.std(axis=0) if scaled else np.ones(z.shape[1])
    scale = np.where(scale == 0, 1, scale)
    x = (z - mean) / scale
    beta = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ (y - y.mean()))
    return lambda rows: (rows - mean) / scale @ beta + y.mean()


def best_alpha(x: np.ndarray, y: np.ndarray, alphas: list[float], folds: int) -> float:
    """The first alpha of the least mean error over folds counted back from the end, each trained on all before it."""
    n, best, choice = len(y), np.inf, alphas[0]
    size = max(20, n // (folds + 1))
    for alpha in alphas:
        errors = []
        for k in range(folds):
            begin = n - (k + 1) * size
            if begin >= max(size, 50):
                part = slice(begin, begin + size)
                errors.append(np.sqrt(np.mean((_regression(x[:begin], y[:begin], alpha)(x[part]) - y[part]) ** 2)))
        if errors and np.mean(errors) < best:
            best, choice = np.mean(errors), alpha
    return choice


def ridge_tuned(data: DataFrame, features: list[str], target: str, window: int = 1260, step: int = 2, alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0), folds: int = 5, least: int = 200, isolate: bool = False) -> DataFrame:
    """(ticker, dt, ridge_tuned): as ridge, with the penalty chosen in each window by walk-forward folds; at least 1e-8."""

    def run(x, own):
        at, value = refits(x, own, window, max(least, folds * 20), lambda z, y: _regression(z, y, best_alpha(z, y, list(alphas), folds)))
        return at, np.maximum(value, 1e-8)

    made = walk(data, "ridge_tuned", [*features, target], run, lambda n: np.arange(window, n, step), isolate=isolate)
    return made if isolate else on_rows(data, made, "ridge_tuned")


def stacking(wide: DataFrame, models: list[str], window: int = 252, step: int = 21, least: int = 100) -> DataFrame:
    """(ticker, dt, stacking): ridge regression of the realized volatility on forecasts, refitted every ``step`` rows; at least 1e-8."""

    def run(x, own):
        at, value = [], []
        fine = np.isfinite(x).all(axis=1)
        for t in own:
            use = np.flatnonzero(fine[t - window : t]) + t - window
            if len(use) >= least:
                at.append(np.arange(t, t + step))
                value.append(np.maximum(1e-8, _regression(x[use, :-1], x[use, -1], 1.0, scaled=False)(x[t : t + step, :-1])))
        return (np.concatenate(at), np.concatenate(value)) if at else ([], [])

    wide = wide.na.drop(subset=["realized", *models])
    return on_rows(wide, walk(wide, "stacking", [*models, "realized"], run, lambda n: np.arange(window, n - step, step)), "stacking")


def long_form(wide: DataFrame, models: list[str], keys=("ticker", "dt")) -> DataFrame:
    """(keys, realized, model, place, forecast), one row for each model."""
    cells = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(k).alias("place"), F.col(m).cast("double").alias("forecast")) for k, m in enumerate(models)))
    return wide.select(*keys, "realized", F.explode(cells).alias("c")).select(*keys, "realized", "c.model", "c.place", "c.forecast")


def rank_ensemble(wide: DataFrame, models: list[str], window: int = 252, least: int = 50) -> DataFrame:
    """(ticker, dt, ensemble): forecasts weighted by one over the rank of their error in the ``window`` rows before.

    Any number of models; instruments with fewer than ``window`` + 10 common rows have none. Rows follow each other without gaps,
    so nothing is left to fill forward.
    """
    long = long_form(wide.na.drop(subset=["realized", *models]), models)
    by = Window.partitionBy("ticker", "model").orderBy("dt")
    before = by.rowsBetween(-window, -1)
    error = F.pow(F.col("realized") - F.col("forecast"), 2)
    rmse = F.when(F.count(error).over(before) >= least, F.sqrt(F.avg(error).over(before))).otherwise(F.lit(float("inf")))
    long = long.withColumns({"rmse": rmse, "n": F.row_number().over(by), "all": F.count("*").over(Window.partitionBy("ticker", "model"))})
    long = long.where((F.col("n") > window) & (F.col("all") >= window + 10))
    rank = F.row_number().over(Window.partitionBy("ticker", "dt").orderBy("rmse", "place"))
    return long.withColumn("w", 1.0 / rank).groupBy("ticker", "dt").agg((F.sum(F.col("w") * F.col("forecast")) / F.sum("w")).alias("ensemble"))
