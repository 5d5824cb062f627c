"""Daily bars from the order tables: all instruments in one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import by_day


def _bars(trades: DataFrame) -> DataFrame:
    """trades(ticker, dt, price, key): open is the price of the least key, close the mean in whole cents."""
    cents = F.sum(F.round(F.col("price") * 100).cast("long")).cast("double") / F.count("*") / 100
    return trades.groupBy("ticker", "dt").agg(F.min(F.struct("key", "price"))["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), cents.alias("close"))


def with_returns(bars: DataFrame) -> DataFrame:
    """Simple and log returns; the first row of each instrument goes."""
    before = F.nullif(F.lag("close").over(by_day()), F.lit(0.0))
    return bars.withColumns({"ret": F.col("close") / before - 1, "logret": F.ln(F.col("close") / before)}).where("ret IS NOT NULL")


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument for each return flag."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _bars(t.select(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("dt"), F.col("l_extendedprice").alias("price"), F.struct("l_orderkey", "l_linenumber").alias("key")))


def segment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument for each market segment of the orders' customers."""
    orders, customers = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer"))
    t = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return _bars(t.select(F.col("c_mktsegment").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt"), F.col("o_totalprice").alias("price"), F.struct("o_orderkey").alias("key")))


def tickers(reference: DataFrame, column: str, longest: int = 5) -> DataFrame:
    """Clean symbols of a reference table: trimmed, not empty, not "nan", of at most ``longest`` characters."""
    symbol = F.trim(column)
    return reference.select(symbol.alias("symbol")).where((F.length("symbol") > 0) & (F.lower("symbol") != "nan") & (F.length("symbol") <= longest)).distinct()


def ticker_list(symbols: DataFrame, first: int | None = None, separator: str = ",") -> DataFrame:
    """(n, symbols): the ``first`` symbols in order, or all, joined into one string."""
    chosen = symbols.select("symbol").orderBy("symbol")
    chosen = chosen if first is None else chosen.limit(first)
    return chosen.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("symbol")), separator).alias("symbols"))


def long_enough(bars: DataFrame, least: int = 600) -> DataFrame:
    """Bars of instruments with at least so many rows."""
    return bars.join(bars.groupBy("ticker").count().where(F.col("count") >= least).select("ticker"), "ticker", "left_semi")
