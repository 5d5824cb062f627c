"""Plans that put the operators together: target, forecasts, evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import by_day, forward_fill
from ..functions.volatility import annualized, forward_realized, realized
from ..operators import evaluation, features, forecasts, garch, trees

MODELS = ["naive", "roll_mean", "har_rv", "ewma"]
#: Rows of training that the regression models need.
WINDOW = 252


@dataclass(frozen=True)
class Setting:
    """What the models of a frame share."""

    horizon: int = 1
    window: int = WINDOW
    step: int = 2
    #: Takes the name and the rows of each model that is fitted in Python, failures among them (``walks.walk``), and returns the rows to go on with.
    keep: Callable[[str, DataFrame], DataFrame] | None = None


def _joined(made: Callable[[DataFrame, Setting], DataFrame]) -> Callable[[DataFrame, Setting], DataFrame]:
    return lambda df, s: df.join(made(df, s), ["ticker", "dt"], "left")


def _fitted(name: str, made: Callable[..., DataFrame]) -> Callable[[DataFrame, Setting], DataFrame]:
    """A model that is fitted in Python; with ``keep`` an instrument whose fit fails has no forecasts and does not end the job."""

    def add(df: DataFrame, s: Setting) -> DataFrame:
        if s.keep is None:
            return made(df, s)
        return s.keep(name, made(df, s, isolate=True)).where("error IS NULL").select("ticker", "dt", name)

    return _joined(add)


def _on_features(fit: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def made(df: DataFrame, s: Setting, **more) -> DataFrame:
        built, names = features.build(df)
        return fit(built, names, "realized", s.window, s.step, **more)

    return made


#: Each model adds a column of its name to bars with ``realized`` and ``rv``.
REGISTRY: dict[str, Callable[[DataFrame, Setting], DataFrame]] = {
    "naive": lambda df, s: df.withColumn("naive", forecasts.naive("rv", s.horizon)),
    "roll_mean": lambda df, s: df.withColumn("roll_mean", forecasts.rolling_mean("rv", 22, s.horizon)),
    "har_rv": lambda df, s: forecasts.har(df, s.window).withColumn("har_rv", annualized(F.col("har_rv"), horizon=1)),
    "ewma": _joined(lambda df, s: forecasts.ewma(df)),
    "gas": _joined(lambda df, s: forecasts.gas(df)),
    **{f.__name__: _fitted(f.__name__, _on_features(f)) for f in (forecasts.ridge, forecasts.ridge_tuned, trees.boosted_trees)},
    **{k: _fitted(k, lambda df, s, k=k, **more: garch.garch(df, k, s.window, s.step, **more)) for k in garch.KINDS},
}


def forecast_frame(bars: DataFrame, horizon: int = 1, window: int = WINDOW, models: list[str] | None = None, step: int = 2, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Bars with ``realized`` (the next ``horizon`` rows, annualised) and one column for each of the models; all instruments in one plan.

    Forecasts are filled forward; rows without any forecast or without a realized value go. With both "ridge" and "garch" a
    rank-weighted "ensemble" of the two can be asked for, as the reference's runs do. ``keep``: see Setting.
    """
    models, setting = models or MODELS, Setting(horizon, window, step, keep)
    df = bars.withColumns({"realized": forward_realized(horizon), "rv": annualized(realized(horizon), horizon=horizon)})
    plain = [m for m in models if m != "ensemble"]
    if unknown := set(plain) - set(REGISTRY):
        raise ValueError(f"unknown models: {sorted(unknown)}")
    for m in plain:
        df = REGISTRY[m](df, setting)
    df = df.withColumns({m: forward_fill(F.col(m), by_day()) for m in plain})
    if "ensemble" in models:
        df = df.join(forecasts.rank_ensemble(df, ["ridge", "garch"]), ["ticker", "dt"], "left")
    return df.na.drop("all", subset=models).na.drop(subset=["realized"])


def model_metrics(bars: DataFrame, horizon: int = 1, window: int = WINDOW, models: list[str] | None = None) -> DataFrame:
    """Losses of each model on each instrument."""
    return evaluation.metrics(forecasts.long_form(forecast_frame(bars, horizon, window, models), models or MODELS), "ticker", "model")


def horizons(bars: DataFrame, of: tuple[int, ...] = (1, 5, 21), window: int = WINDOW, models: list[str] | None = None) -> DataFrame:
    """Losses of each model on each instrument and for each horizon."""
    out = None
    for h in of:
        one = model_metrics(bars, h, window, models).withColumn("horizon", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out
