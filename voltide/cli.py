"""Command line: ``python -m voltide.cli daily|cross-sectional|experiments|tomorrow-position --data DIR``."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import functions as F

from .operators import evaluation, forecasts, portfolio
from .plans import experiments, pipeline
from .session import local_session, shared_folder, ship_package
from .sources import tables
from .sources.bars import lineitem_bars, segment_bars, with_returns

SOURCES = {"lineitem": lineitem_bars, "segments": segment_bars}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="voltide", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("daily", "cross-sectional", "experiments", "tomorrow-position"):
        s = sub.add_parser(name)
        s.add_argument("--data", required=True, help="folder of the order tables")
        s.add_argument("--source", choices=SOURCES, default="lineitem")
        s.add_argument("--tickers", default=None, help="with commas; all if left out")
        s.add_argument("--models", default=",".join(pipeline.MODELS))
        s.add_argument("--horizon", type=int, default=1)
        s.add_argument("--window", type=int, default=pipeline.WINDOW)
        s.add_argument("--export", default=None, help="folder that results are written to")
        if name == "experiments":
            s.add_argument("--config", default=None, help="JSON file with fields of a run")
            s.add_argument("--run", default=None, help="only show the leaderboard of this saved run")
            s.add_argument("--master", action="store_true", help="only show all saved runs and the settings in which they differ")
        if name == "tomorrow-position":
            s.add_argument("--equity", type=float, default=10_000.0)
            s.add_argument("--target", type=float, default=0.10)
            s.add_argument("--model", default="ewma")
    return p


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    spark = ship_package(spark or local_session("voltide"))
    bars = with_returns(SOURCES[a.source](spark, a.data))
    if a.tickers:
        bars = bars.where(F.col("ticker").isin([x.strip() for x in a.tickers.split(",")]))
    models = a.models.split(",")
    if a.command == "experiments":
        fields = {"models": models, "horizon": a.horizon, "window": a.window, "tickers": a.tickers}
        if a.config:
            with open(a.config, encoding="utf-8") as f:
                fields |= json.load(f)
        base = a.export or "experiments"
        if a.master:
            experiments.master(spark, base).orderBy("run_id", "mae").show(truncate=False)
            experiments.differing(spark, base).orderBy("field", "run_id").show(truncate=False)
            return
        if a.run:
            experiments.leaderboard(spark, base, a.run).orderBy("mae").show(truncate=False)
            return
        run_id = experiments.run(bars, experiments.Config(**fields), base)
        experiments.leaderboard(spark, base, run_id).orderBy("mae").show(truncate=False)
        experiments.errors(spark, base, run_id).show(truncate=False)
        return
    wide = pipeline.forecast_frame(bars, a.horizon, a.window, models)
    metrics = evaluation.metrics(forecasts.long_form(wide, models), "ticker", "model")
    if a.command == "daily":
        base, today = a.export or shared_folder(spark), dt.date.today().isoformat()
        tables.save_signals(wide.select("dt", "ticker", "close", "ret", *models), base, today)
        found = {"latest": tables.latest(tables.newest_signals(spark, base), "dt"), "metrics": metrics.orderBy("ticker", "mae")}
    elif a.command == "cross-sectional":
        found = {"cross_section": portfolio.one_row_each(metrics, models), "by_model": portfolio.by_model(metrics), "wins": portfolio.wins(metrics, models)}
    else:
        found = {"positions": portfolio.next_positions(wide, a.model, a.equity, target=a.target)}
    for name, table in found.items():
        if a.export:
            table.write.mode("overwrite").parquet(f"{a.export}/{name}")
        table.show(truncate=False)


if __name__ == "__main__":
    main()
