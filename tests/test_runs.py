"""Tables of runs, the command line, the stream and the model registry."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltide import cli
from voltide.operators import walks
from voltide.plans import experiments, pipeline
from voltide.sources import tables
from voltide.sources.bars import lineitem_bars, with_returns
from voltide.streaming.bars import closed_days, daily_bars


@pytest.fixture(scope="module")
def bars(spark, medium):
    return with_returns(lineitem_bars(spark, medium))


def test_runs_are_saved_and_read(spark, bars, tmp_path):
    base = str(tmp_path)
    for run_id, names in (("first", "A, N"), ("second", ["R"])):
        experiments.run(bars, experiments.Config(tickers=names, models=["naive", "ewma"]), base, run_id)
    assert {os.path.basename(x) for x in glob.glob(f"{base}/*")} == {"eval", "metrics", "by_regime", "dm", "backtest", "var_es", "by_model", "errors", "runs"}
    log = spark.read.parquet(f"{base}/runs")
    assert tables.newest(log) == "second" and {r["run_id"]: r["tickers"] for r in log.collect()} == {"first": "A,N", "second": "R"}
    assert {r["ticker"] for r in tables.load(spark, base, "metrics").collect()} == {"R"}
    assert {r["ticker"] for r in tables.load(spark, base, "var_es", "first").collect()} == {"A", "N"}
    assert {r["model"]: r["n"] for r in experiments.leaderboard(spark, base, "first").collect()} == {"naive": 2, "ewma": 2}
    before = tables.load(spark, base, "metrics", "first").count()
    tables.save(tables.load(spark, base, "by_model", "second").drop("run_id"), base, "by_model", "second2")
    assert tables.load(spark, base, "metrics", "first").count() == before
    assert experiments.results(tables.load(spark, base, "eval", "second"), experiments.Config(models=["naive", "ewma"]))["dm"].count() == 1


def test_too_few_rows_give_no_results(spark, bars):
    assert experiments.frame(bars, experiments.Config(least_rows=10_000)).count() == 0


def test_cache(spark, tmp_path):
    calls = []
    make = lambda n: lambda: calls.append(n) or spark.range(n)
    assert tables.cached(spark, f"{tmp_path}/t", make(0)).count() == 0
    assert tables.cached(spark, f"{tmp_path}/t", make(3)).count() == 3 and tables.cached(spark, f"{tmp_path}/t", make(4)).count() == 3
    assert calls == [0, 3]


def test_registry(bars):
    one = bars.where("ticker = 'A'").where(F.col("dt") >= "1996-06-01")
    wide = pipeline.forecast_frame(one, window=252, step=40, models=["ridge", "garch", "gas", "garch_t", "ensemble"])
    row = wide.select(*(F.count(c).alias(c) for c in ["realized", "ridge", "garch", "gas", "garch_t", "ensemble"])).first()
    assert all(v > 0 for v in row) and row["ensemble"] < row["garch"]
    with pytest.raises(ValueError, match="unknown"):
        pipeline.forecast_frame(one, models=["other"])


@pytest.mark.parametrize("command", ["daily", "cross-sectional", "tomorrow-position", "experiments"])
def test_command_line(spark, medium, tmp_path, command, capsys):
    cli.main([command, "--data", medium, "--models", "naive,ewma", "--tickers", "A,R", "--export", f"{tmp_path}/out"], spark)
    assert "ewma" in capsys.readouterr().out or command == "tomorrow-position"
    assert glob.glob(f"{tmp_path}/out/*/*")


def test_stream_closes_the_days_that_a_batch_has(spark, medium):
    closed = {(r["ticker"], r["dt"]): tuple(r) for r in closed_days(spark, medium).collect()}
    every = {(r["ticker"], r["dt"]): tuple(r) for r in daily_bars(spark.read.parquet(f"{medium}/events.parquet")).collect()}
    last = max(d for _, d in every)
    assert closed and {k: v for k, v in every.items() if k[1] < last} == closed


def test_late_events_are_dropped(spark, medium, tmp_path):
    events = spark.read.parquet(f"{medium}/events.parquet").orderBy("ts").limit(3000).cache()
    middle = events.select(F.expr("percentile(unix_timestamp(ts), 0.5)")).first()[0]
    early, rest = events.where(F.unix_timestamp("ts") <= middle), events.where(F.unix_timestamp("ts") > middle)
    for name, df in (("1", early), ("2", rest), ("3", events.orderBy("ts").limit(5).withColumn("event_id", -F.col("event_id")))):
        df.coalesce(1).write.parquet(f"{tmp_path}/w{name}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(glob.glob(f"{tmp_path}/w{name}/*.parquet")[0], f"{tmp_path}/in/{name}.parquet")
        os.utime(f"{tmp_path}/in/{name}.parquet", (int(name), int(name)))
    closed = closed_days(spark, f"{tmp_path}/in", "*.parquet").agg(F.sum("n")).first()[0]
    days = daily_bars(events)
    assert closed == days.where(F.col("dt") < days.agg(F.max("dt")).first()[0]).agg(F.sum("n")).first()[0]


def test_runs_are_compared_by_their_settings(spark, tmp_path):
    rows = [("a", '{"window": 252, "models": ["x", "y"], "tickers": null}'), ("b", '{"window": 252, "models": ["x"], "tickers": null, "step": 1}')]
    log = spark.createDataFrame(rows, "run_id string, config string")
    log.write.parquet(f"{tmp_path}/runs")
    got = sorted(tuple(r) for r in experiments.differing(spark, str(tmp_path)).select("field", "run_id", "value").collect())
    assert got == [("models", "a", '["x","y"]'), ("models", "b", '["x"]'), ("step", "b", "1")]
    spark.createDataFrame([("a", "x", 0.5), ("a", "x", 1.5), ("b", "x", 3.0)], "run_id string, model string, mae double").write.parquet(f"{tmp_path}/metrics")
    assert sorted(tuple(r) for r in experiments.master(spark, str(tmp_path)).collect()) == [("a", 2, "x", 1.0, 2), ("b", 1, "x", 3.0, 1)]


def test_a_failing_instrument_ends_no_run(spark, bars, tmp_path, monkeypatch):
    """One instrument that breaks a fit is in the table of errors; the others have the rows of a run without it."""

    def fit(x, own):
        if np.nanmax(x) > 1e6:
            raise FloatingPointError("returns out of range")
        return own, [np.abs(x[t - 50 : t, 0]).mean() for t in own]

    def fragile(df, s, **more):
        step = s.step
        made = walks.walk(df, "fragile", ["ret"], fit, lambda n: np.arange(50, n, step), blocks=3, **more)
        return made if more else walks.on_rows(df, made, "fragile")

    monkeypatch.setitem(pipeline.REGISTRY, "fragile", pipeline._fitted("fragile", fragile))
    config = experiments.Config(models=["naive", "ridge", "fragile"], step=60, start="1995-01-01", end="1997-12-31", least_rows=300)
    ret = F.when((F.col("ticker") == "N") & (F.col("dt") > "1996-06-01"), F.lit(1e9)).otherwise(F.col("ret"))
    experiments.run(bars.withColumn("ret", ret), config, f"{tmp_path}/a", "bad")
    assert [(r["ticker"], r["model"], r["error"]) for r in experiments.errors(spark, f"{tmp_path}/a").collect()] == [("N", "fragile", "FloatingPointError: returns out of range")]
    experiments.run(bars.where("ticker <> 'N'"), config, f"{tmp_path}/b", "good")
    assert experiments.errors(spark, f"{tmp_path}/b").count() == 0
    for name in ("eval", "metrics", "backtest", "var_es"):
        a, b = (tables.load(spark, f"{tmp_path}/{x}", name).drop("run_id").collect() for x in "ab")
        assert a and sorted(map(str, a)) == sorted(map(str, b)), name
    day = tables.load(spark, f"{tmp_path}/b", "eval").agg(F.min("dt"), F.max("dt"), F.count("fragile"), F.count("ridge")).first()
    assert str(day[0]) >= "1995-01-01" and str(day[1]) <= "1997-12-31" and day[2] > 0 and day[3] > 0


def test_failures_without_isolation_name_the_instrument(spark):
    def fit(x, own):
        if x[0, 0] > 0:
            raise ValueError("bad")
        return own, x[own, 0]

    rows = spark.createDataFrame([(t, dt.date(2020, 1, k), v) for t, v in (("good", -1.0), ("bad", 1.0)) for k in (1, 2, 3)], "ticker string, dt date, v double")
    made = walks.walk(rows, "f", ["v"], fit, lambda n: np.arange(n), blocks=2, isolate=True)
    assert sorted(map(tuple, made.where("error IS NULL").collect())) == [("good", dt.date(2020, 1, k), -1.0, None) for k in (1, 2, 3)]
    assert {tuple(r) for r in made.where("error IS NOT NULL").collect()} == {("bad", None, None, "ValueError: bad")}
    with pytest.raises(Exception, match="f failed for bad"):
        walks.walk(rows, "f", ["v"], fit, lambda n: np.arange(n)).collect()
    assert walks.walk(rows.limit(0), "f", ["v"], fit, lambda n: np.arange(n), isolate=True).count() == 0
