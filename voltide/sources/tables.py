"""Tables of experiments: one folder for each kind, partitioned by run; logs that are appended to; reads through a cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "runs"


def save(df: DataFrame, base: str, name: str, run_id: str) -> None:
    """A run's rows of a table; saving the same run again replaces them and leaves other runs alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{base}/{name}")


def append(df: DataFrame, base: str, name: str) -> None:
    """Rows added to a log (runs, orders)."""
    df.write.mode("append").parquet(f"{base}/{name}")


def newest(runs: DataFrame) -> str | None:
    """The run with the latest timestamp."""
    row = runs.agg(F.max_by("run_id", F.struct("timestamp", "run_id")).alias("run_id")).first()
    return row and row["run_id"]


def load(spark: SparkSession, base: str, name: str, run_id: str | None = None, schema: str | None = None) -> DataFrame:
    """A table's rows of a run, by default the newest; only that partition is read. A table that may have no rows at all needs its schema."""
    run_id = run_id or newest(spark.read.parquet(f"{base}/{RUNS}"))
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, run_id string")
    return reader.parquet(f"{base}/{name}").where(F.col("run_id") == run_id)


def latest(df: DataFrame, partition: str) -> DataFrame:
    """Rows of the greatest partition value, a scalar subquery: of a partitioned table only that partition is read, found at run time."""
    return df.where(F.col(partition) == df.agg(F.max(partition)).scalar())


def save_signals(df: DataFrame, base: str, run_date: Column | str) -> None:
    """Signals by the date of their run; saving a date again replaces it and leaves others alone."""
    day = F.lit(run_date).cast("date") if isinstance(run_date, str) else run_date
    df.withColumn("signal_run_date", day).repartition("signal_run_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signal_run_date").parquet(f"{base}/signals")


def newest_signals(spark: SparkSession, base: str) -> DataFrame:
    """The signals of the newest run date; no other partition is read."""
    return latest(spark.read.parquet(f"{base}/signals"), "signal_run_date")


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def missing(asked: DataFrame, held: DataFrame | None) -> DataFrame:
    """(ticker, first, last): the days of asked(ticker, first, last) that no interval of held(ticker, first, last) covers. Days are whole, both ends count."""
    asked = asked.select("ticker", "first", "last").where("first <= last")
    if held is None:
        return asked
    own = asked.select("ticker", F.col("first").alias("a"), F.col("last").alias("z"))
    cover = own.join(held, "ticker").where("last >= a AND first <= z").select("ticker", "a", "z", "first", "last")
    edges = own.select("ticker", "a", "z", F.date_sub("a", 1).alias("first"), F.date_sub("a", 1).alias("last")).unionByName(own.select("ticker", "a", "z", F.date_add("z", 1).alias("first"), F.date_add("z", 1).alias("last")))
    before = F.max("last").over(Window.partitionBy("ticker", "a", "z").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    gaps = cover.unionByName(edges).withColumn("before", before).where(F.datediff("first", "before") > 1)
    return gaps.select("ticker", F.date_add("before", 1).alias("first"), F.date_sub("first", 1).alias("last"))


def cached_ranges(spark: SparkSession, base: str, asked: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (ticker, dt, ...) of asked(ticker, first, last) through a table partitioned by ticker and a log of covered intervals.

    Only intervals that no earlier request has covered are handed to ``make``, which returns their rows. They are added with
    their intervals; an interval that gave no row is not logged and asked for again. One writer at a time.
    """
    log = _there(spark, f"{base}/covered")
    wanted = missing(asked.distinct(), log)
    if not wanted.isEmpty():
        run = uuid.uuid4().hex
        fresh = f"{base}/fresh/{run}"
        wanted.write.parquet(f"{fresh}/asked")  # settled before the tables that it is made from change
        settled = spark.read.parquet(f"{fresh}/asked")
        make(settled).write.parquet(f"{fresh}/rows")
        rows = spark.read.parquet(f"{fresh}/rows")
        filled = settled.join(rows.select("ticker", "dt"), (settled["ticker"] == rows["ticker"]) & rows["dt"].between(settled["first"], settled["last"]), "left_semi")
        rows.write.mode("append").partitionBy("ticker").parquet(f"{base}/rows")
        filled.write.mode("append").parquet(f"{base}/covered")
    found = _there(spark, f"{base}/rows")
    if found is None:
        return make(asked.limit(0))
    ask = asked.select(F.col("ticker").alias("__t"), "first", "last").distinct()
    return found.join(ask, (F.col("ticker") == F.col("__t")) & F.col("dt").between(F.col("first"), F.col("last")), "left_semi")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it is not there; an empty result is returned but not kept."""
    found = _there(spark, path)
    if found is not None:
        return found
    made = make()
    if made.isEmpty():
        return made
    made.write.parquet(path)
    return spark.read.parquet(path)
