"""Experiments: one job for all instruments, its tables saved by run, and what is read from them."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, evaluation, forecasts, portfolio, risk
from ..sources import tables
from ..sources.bars import long_enough
from . import pipeline

ERRORS = "ticker string, model string, error string"


@dataclass(frozen=True)
class Config:
    """What a run is made with; ``tickers`` may be a list or a string with commas, none takes all. ``start`` and ``end`` are the first and the last day, none for all."""

    tickers: list[str] | str | None = None
    models: list[str] = field(default_factory=lambda: list(pipeline.MODELS))
    benchmark: str = "ewma"
    horizon: int = 1
    window: int = pipeline.WINDOW
    step: int = 2
    alpha: float = 0.01
    cost_bps: float = 0.0
    slippage_bps: float = 0.0
    least_rows: int = 600
    start: str | None = None
    end: str | None = None

    def chosen(self) -> list[str] | None:
        found = self.tickers.split(",") if isinstance(self.tickers, str) else self.tickers
        return [x.strip() for x in found if x.strip()] if found else None


def frame(bars: DataFrame, config: Config, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Target and forecasts of the chosen instruments; those with too few rows are left out. ``keep``: see pipeline.Setting."""
    chosen = config.chosen()
    for day, name in ((config.start, ">="), (config.end, "<=")):
        bars = bars if day is None else bars.where(F.expr(f"dt {name} DATE '{dt.date.fromisoformat(str(day))}'"))
    bars = long_enough(bars if chosen is None else bars.where(F.col("ticker").isin(chosen)), config.least_rows)
    wide = pipeline.forecast_frame(bars, config.horizon, config.window, config.models, config.step, keep)
    return wide.select("ticker", "dt", "close", "ret", "realized", *config.models)


def results(wide: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The tables that are made from a run's frame, by name."""
    scored = "ridge" if "ridge" in config.models else config.models[0]
    benchmark = config.benchmark if config.benchmark in config.models else config.models[0]
    metrics = evaluation.metrics(forecasts.long_form(wide, config.models), "ticker", "model")
    path = backtest.volatility_target(wide, scored, cost_bps=config.cost_bps, slippage_bps=config.slippage_bps)
    return {
        "metrics": metrics,
        "by_regime": evaluation.by_regime(evaluation.regimes(wide), scored),
        "dm": evaluation.diebold_mariano(wide, config.models, benchmark, config.horizon),
        "backtest": backtest.summary(path),
        "var_es": risk.report(risk.normal_var_es(wide, scored, config.alpha), config.alpha),
        "by_model": portfolio.by_model(metrics),
    }


def run(bars: DataFrame, config: Config, base: str, run_id: str | None = None) -> str:
    """Make and save the tables of a run; forecasts are written once and read by all others. The log of runs is written last.

    An instrument whose fit by some model fails is in none of the tables but ``errors`` (ticker, model, error), and ends no run.
    The rows of models that are fitted in Python are written as they are made, once, to ``fits_<model>``.
    """
    run_id = run_id or f"{uuid.uuid4().hex[:8]}_{dt.datetime.now():%Y%m%d_%H%M}"
    spark = bars.sparkSession
    failed = spark.createDataFrame([], ERRORS)

    def keep(name: str, made: DataFrame) -> DataFrame:
        nonlocal failed
        tables.save(made, base, f"fits_{name}", run_id)
        kept = tables.load(spark, base, f"fits_{name}", run_id, f"ticker string, dt date, {name} double, error string")
        failed = failed.unionByName(kept.where("error IS NOT NULL").groupBy("ticker").agg(F.min("error").alias("error")).withColumn("model", F.lit(name)))
        return kept

    wide = frame(bars, config, keep)
    tables.save(wide.join(failed.select("ticker").distinct(), "ticker", "left_anti"), base, "eval", run_id)
    tables.save(failed, base, "errors", run_id)
    for name, table in results(tables.load(bars.sparkSession, base, "eval", run_id).drop("run_id"), config).items():
        tables.save(table, base, name, run_id)
    entry = (run_id, dt.datetime.now(), ",".join(config.chosen() or ["all"]), json.dumps(asdict(config), default=str))
    tables.append(bars.sparkSession.createDataFrame([entry], "run_id string, timestamp timestamp, tickers string, config string"), base, tables.RUNS)
    return run_id


def errors(spark: SparkSession, base: str, run_id: str | None = None) -> DataFrame:
    """(ticker, model, error) of a run's failures, by default the newest run's."""
    return tables.load(spark, base, "errors", run_id, ERRORS).drop("run_id")


def leaderboard(spark: SparkSession, base: str, run_id: str | None = None) -> DataFrame:
    """Mean errors by model of a run, the newest by default."""
    return portfolio.by_model(tables.load(spark, base, "metrics", run_id))


def settings(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, field, value) of every saved run's configuration, parsed from its JSON; lists are JSON text."""
    return spark.read.parquet(f"{base}/{tables.RUNS}").select("run_id", F.explode(F.from_json("config", "map<string,string>")).alias("field", "value"))


def differing(spark: SparkSession, base: str) -> DataFrame:
    """The settings in which saved runs differ, or that some of them lack."""
    every = settings(spark, base)
    runs = every.agg(F.count_distinct("run_id")).scalar()
    kinds = every.groupBy("field").agg(F.count_distinct(F.struct("value")).alias("values"), F.count("*").alias("runs"))
    return every.join(kinds.where((F.col("values") > 1) | (F.col("runs") < runs)).select("field"), "field", "left_semi")


def master(spark: SparkSession, base: str) -> DataFrame:
    """(run_id, models, model, mae, n): mean errors by model of all saved runs, next to how many models each was made with."""
    asked = settings(spark, base).where("field = 'models'").select("run_id", F.size(F.from_json("value", "array<string>")).alias("models"))
    mean = spark.read.parquet(f"{base}/metrics").groupBy("run_id", "model").agg(F.round(F.avg("mae"), 6).alias("mae"), F.count("*").alias("n"))
    return asked.join(mean, "run_id").select("run_id", "models", "model", "mae", "n")


def regime_table(by_regime: DataFrame) -> DataFrame:
    """Losses by regime to six decimals."""
    return by_regime.select("ticker", "regime", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "qlike")))


def dm_summary(dm: DataFrame) -> DataFrame:
    """(model, mean_p, std_p) of the tests against the benchmark over all instruments."""
    return dm.groupBy("model").agg(F.avg("p").alias("mean_p"), F.stddev_samp("p").alias("std_p"))
