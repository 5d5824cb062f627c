"""Recurrences v' = max(a v + b, floor) over long series, cut into blocks that are folded apart and stitched.

Such maps compose into maps of the same kind, v -> max(A v + B, C), so a block of days is one map whatever value enters it.
Blocks are folded in the JVM by as many tasks as there are blocks; a series is only met as one map a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block, by the calendar: a row finds its block without counting rows.
BLOCK_DAYS = 256
#: Below every value: the bound of a map that has none.
LOWEST = -1e300
_ROW = "array<struct<dt:date,a:double,b:double,c:double>>"


def _composed(a, b, c, decay: float, drive: Column, floor: float) -> tuple[Column, Column, Column]:
    """The map (a, b, c) followed by v -> max(decay v + drive, floor); decay is not negative."""
    return decay * a, decay * b + drive, F.greatest(decay * c + drive, F.lit(floor))


def recurrence(rows: DataFrame, by: list[str], drive: Column, decay: float, start: int, initial: Column, floor: float | None = None) -> DataFrame:
    """(by, dt, value): ``value`` of a row is what the rows before it make of ``initial``, an aggregate of the first ``start`` rows.

    The last of the first ``start`` rows has the initial value, rows before it have none, nor has a series of fewer rows.
    Each row then moves the value to max(decay * value + drive, floor) for the next one. ``dt`` is a date, once in a series;
    a null ``drive`` leaves nulls behind it. An empty table gives no rows; other columns are not read. ``decay`` >= 0.
    """
    if decay < 0:
        raise ValueError("a falling map does not keep the larger of two values")
    low = LOWEST if floor is None else floor
    block = F.floor(F.unix_date("dt") / BLOCK_DAYS).alias("block")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("dt"))).where(F.col("__n") <= start)
    begun = first.groupBy(*by).agg(F.count("*").alias("__k"), initial.cast("double").alias("entering"), F.max("dt").alias("since")).where(F.col("__k") == start).drop("__k")
    # The few blocks that the first rows lie in learn where the series begins.
    marks = first.select(*by, block).distinct().join(begun.select(*by, "since"), by)
    days = rows.select(*by, block, F.struct("dt", drive.cast("double").alias("x")).alias("row")).unionByName(marks, allowMissingColumns=True)
    parts = days.groupBy(*by, "block").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.max("since").alias("since"))

    def step(acc: Column, row: Column) -> Column:
        on = F.col("since").isNull() | (row["dt"] >= F.col("since"))
        moved = _composed(acc["a"], acc["b"], acc["c"], decay, row["x"], low)
        kept = [F.when(on, m).otherwise(acc[k]).alias(k) for k, m in zip("abc", moved, strict=True)]
        return F.struct(*kept, F.concat(acc["out"], F.array(F.struct(row["dt"].alias("dt"), *(acc[k].alias(k) for k in "abc")))).alias("out"))

    nothing = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(LOWEST).alias("c"), F.array().cast(_ROW).alias("out"))
    folded = parts.select(*by, "block", "since", F.aggregate("rows", nothing, step).alias("map"))

    def stitch(acc: Column, part: Column) -> Column:
        after = F.greatest(part["a"] * acc["v"] + part["b"], part["c"])
        return F.struct(F.when(acc["v"].isNotNull(), after).alias("v"), F.concat(acc["out"], F.array(F.struct(part["block"].alias("block"), acc["v"].alias("v")))).alias("out"))

    chain = folded.select(*by, F.struct("block", "map.a", "map.b", "map.c").alias("part")).groupBy(*by).agg(F.sort_array(F.collect_list("part")).alias("parts")).join(begun.select(*by, "entering"), by)
    enter = chain.select(*by, F.explode(F.aggregate("parts", F.struct(F.col("entering").alias("v"), F.array().cast("array<struct<block:bigint,v:double>>").alias("out")), stitch)["out"]).alias("e")).select(*by, "e.block", "e.v")
    out = folded.join(enter, [*by, "block"], "left").select(*by, "since", "v", F.explode("map.out").alias("r"))
    there = F.col("v").isNotNull() & (F.col("since").isNull() | (F.col("r.dt") >= F.col("since")))
    return out.select(*by, "r.dt", F.when(there & F.col("r.b").isNotNull(), F.greatest(F.col("r.a") * F.col("v") + F.col("r.b"), F.col("r.c"))).alias("value"))
