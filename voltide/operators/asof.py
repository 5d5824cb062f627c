"""As-of alignment: each row with the newest row of another series at or before it, whatever the two calendars are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a block. A key's rows are carried forward block by block, so a key that holds most rows is no single task.
BLOCK_SECONDS = 86_400


def asof(left: DataFrame, right: DataFrame, by: str, time: str = "ts", tolerance_seconds: float | None = None) -> DataFrame:
    """left plus ``matched``: the struct of the right row of the same ``by`` with the greatest time not after the left row's.

    Of right rows at one time the greatest struct counts. Without such a row, or with one older than ``tolerance_seconds``,
    ``matched`` is null; so is it for a null key or time. Left rows all stay, equal ones too; an empty right table matches
    nothing. Right times must not be null to match.

    Both sides are put on one line of time and carried forward within blocks of a day; a block's last right row enters the
    blocks after it through a table of a row for each key and block.
    """
    values = [c for c in right.columns if c not in (by, time)]
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    block = F.floor(F.col("__at") / (BLOCK_SECONDS * 1_000_000))
    found = F.struct(F.col(time).cast("timestamp").alias(time), *values)
    r = right.where(F.col(time).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("__by"), at(time).alias("__at"), found.alias("__right"))
    here = left.select(F.struct(*left.columns).alias("__left"), F.col(by).alias("__by"), at(time).alias("__at"))
    line = r.withColumn("__left", F.lit(None).cast(here.schema["__left"].dataType)).unionByName(here.withColumn("__right", F.lit(None).cast(r.schema["__right"].dataType))).withColumn("__block", block)
    within = Window.partitionBy("__by", "__block").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("__near", F.max("__right").over(within))  # structs compare by time first
    last = r.withColumn("__block", block).groupBy("__by", "__block").agg(F.max("__right").alias("__last"))
    spine = line.select("__by", "__block").distinct().join(last, ["__by", "__block"], "left")
    enter = spine.withColumn("__enter", F.last("__last", ignorenulls=True).over(Window.partitionBy("__by").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    rows = line.where("__left IS NOT NULL").join(enter, ["__by", "__block"], "left")
    newest = F.coalesce("__near", "__enter")
    fine = F.col("__at").isNotNull() if tolerance_seconds is None else F.col("__at") - at("__m." + time) <= int(tolerance_seconds * 1_000_000)
    return rows.withColumn("__m", newest).select("__left.*", F.when(fine, F.col("__m")).alias("matched"))
