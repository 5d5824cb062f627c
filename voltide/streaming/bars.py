"""Daily bars of an event stream, by watermark and tumbling windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def daily_bars(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(ticker, dt, open, high, low, close, n) of events(event_id, ts, event_type, value), streaming or not.

    Open and close are the values of the least and the greatest (time, id) of a day. Of a stream, a day is given once it is
    closed: when an event ``late`` after its end has come. Events that come later than that are dropped.
    """
    stamped = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("ticker"), "value")
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    order = F.struct("ts", "event_id")
    day = stamped.groupBy("ticker", F.window("ts", "1 day").alias("w"))
    made = day.agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("n"))
    return made.select("ticker", F.col("w.start").cast("date").alias("dt"), "open", "high", "low", "close", "n")


def closed_days(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """The days that a stream over the files of a folder has closed once all have been read, through a Parquet sink."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = daily_bars(stream).writeStream.format("parquet").option("path", f"{out}/bars").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("ticker string, dt date, open double, high double, low double, close double, n long").parquet(f"{out}/bars")
