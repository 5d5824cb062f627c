"""Session windows, sliding windows and recursive volatility of an event stream, each given once it is closed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.volatility import TRADING_DAYS
from ..session import shared_folder


def stamped(events: DataFrame, late: str) -> DataFrame:
    """(event_id, ts, user_id, ticker, value) of events; of a stream, with a watermark ``late`` behind the newest event."""
    out = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("ticker"), "value")
    return out.withWatermark("ts", late) if events.isStreaming else out


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, finish, n, value, first_type, last_type): a user's events that follow each other within ``gap``; it finishes a gap after the last.

    Windows merge as events arrive, also where a late one bridges two of them. Of a stream, a session is given when the
    watermark has passed its finish; an event behind the watermark of the trigger before is dropped. Null users are a user of their own.
    """
    order = F.struct("ts", "event_id")
    made = stamped(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    # Start and end as aggregates: a filter on the window itself would be pushed below the merging and split sessions.
    bounds = F.min("ts").alias("start"), (F.max("ts") + F.expr(f"INTERVAL {gap}")).alias("finish")
    out = made.agg(*bounds, F.count("*").alias("n"), F.sum("value").alias("value"), F.min_by("ticker", order).alias("first_type"), F.max_by("ticker", order).alias("last_type"))
    return out.select("user_id", "start", "finish", "n", "value", "first_type", "last_type")


def sliding(events: DataFrame, length: str = "6 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(ticker, start, n, value, most): events of overlapping windows of one ``length``, one each ``slide``.

    An event is counted in each window that holds it, combined before the shuffle. Of a stream, closed windows only.
    """
    made = stamped(events, late).groupBy("ticker", F.window("ts", length, slide).alias("w"))
    return made.agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max("value").alias("most")).select("ticker", F.col("w.start").alias("start"), "n", "value", "most")


class Recursion:
    """One instrument's returns so far: what the recursive variances of the next row need, and nothing else."""

    FIELDS = "at long, n long, close double, mean double, spread double, square double, ret double, ewma double, gas double"

    def __init__(self, burn_in: int, window: int, expiry_ms: int, held: tuple | None = None):
        self.burn_in, self.window, self.expiry = burn_in, window, expiry_ms
        self.begin() if held is None else self.__dict__.update(zip((f.split()[0] for f in self.FIELDS.split(", ")), held, strict=True))

    def begin(self) -> None:
        self.at = self.close = self.ret = self.ewma = self.gas = None
        self.n, self.mean, self.spread, self.square = 0, 0.0, 0.0, 0.0

    def held(self) -> tuple:
        return tuple(getattr(self, f.split()[0]) for f in self.FIELDS.split(", "))

    def meet(self, at: int, close: float) -> tuple | None:
        """The row (return, ewma variance, gas variance) of a bar; the first one of a series, and one after a price of zero, has none."""
        if self.at is not None and at <= self.at:
            return None
        if self.at is not None and at - self.at > self.expiry:
            self.begin()
        before, self.at, self.close = self.close, at, close
        if not before:
            return None
        r = close / before - 1
        self.n += 1
        if self.n <= max(self.burn_in, self.window):
            away = r - self.mean
            self.mean += away / self.n
            self.spread += away * (r - self.mean)
            self.square += r * r
        if self.n == self.burn_in:
            self.ewma = self.spread / (self.n - 1)
        elif self.n > self.burn_in:
            self.ewma = 0.94 * self.ewma + 0.06 * self.ret**2
        if self.n == self.window:
            self.gas = self.square / self.n
        elif self.n > self.window:
            self.gas = max(0.01 + 0.08 * (self.ret**2 - self.gas) + 0.90 * self.gas, 1e-12)
        self.ret = r
        return r, self.ewma, self.gas


def bars(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(ticker, start, close): the last value of each closed window."""
    order = F.struct("ts", "event_id")
    made = stamped(events, late).groupBy("ticker", F.window("ts", width).alias("w")).agg(F.max_by("value", order).alias("close"))
    return made.select("ticker", F.col("w.start").alias("start"), "close").where("close IS NOT NULL")


def recursive_volatility(closed: DataFrame, burn_in: int = 20, window: int = 252, expiry_hours: int = 48) -> DataFrame:
    """(ticker, start, close, ret, ewma, gas) of a stream of closed ``bars``: EWMA and score-driven volatility of their returns, annualised as of days.

    One small state an instrument is carried from trigger to trigger; nothing of the past is read again. An instrument's bars
    come in the order of time, so any cut of the stream into triggers gives the same rows; a bar met before is passed over. A
    series without a bar for more than ``expiry_hours`` begins anew, and its state is dropped once the watermark shows that it must.
    """
    hour = 3_600_000
    result = "ticker string, start timestamp, close double, ret double, ewma double, gas double"

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        series = Recursion(burn_in, window, expiry_hours * hour, state.get if state.exists else None)
        fresh = pd.concat(list(batches)).sort_values("start")  # the bars of one trigger
        rows = []
        for start, close in zip(fresh["start"], fresh["close"], strict=True):
            made = series.meet(start.value // 1_000_000, float(close))
            if made is not None:
                r, v, g = made
                rows.append((key[0], start, float(close), r, None if v is None else (v * TRADING_DAYS) ** 0.5, None if g is None else (g * TRADING_DAYS) ** 0.5))
        state.update(series.held())
        state.setTimeoutTimestamp(max(series.at + expiry_hours * hour + 1, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in result.split(", ")])

    # Files of one trigger may be read one after another, so instruments may run ahead of each other by the expiry.
    timed = closed.withWatermark("start", f"{expiry_hours} hours")
    return timed.groupBy("ticker").applyInPandasWithState(advance, result, Recursion.FIELDS, "append", GroupStateTimeout.EventTimeTimeout)


def through(spark: SparkSession, folder: str, make: Callable[[DataFrame], DataFrame], pattern: str = "events.parquet", files: int = 1, out: str | None = None) -> DataFrame:
    """What ``make`` has given of a stream over a folder's files once all are read, through a Parquet sink; ``out`` (a new folder by default) holds rows and checkpoint, and takes up where it stopped."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    out = out or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return _drained(spark, make(stream), out)


def _drained(spark: SparkSession, made: DataFrame, out: str) -> DataFrame:
    query = made.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{out}/rows")


def recursive(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1, out: str | None = None, **options) -> DataFrame:
    """``recursive_volatility`` of a folder's events in two streams, the closed bars being a table between them; both take up where they stopped."""
    out = out or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    closed = through(spark, folder, bars, pattern, files, f"{out}/bars")
    stream = spark.readStream.schema(closed.schema).parquet(f"{out}/bars/rows")
    return _drained(spark, recursive_volatility(stream, **options), f"{out}/recursive")


def written_out(stamp: str) -> Column:
    """A time as text, to the microsecond."""
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(stamp)
