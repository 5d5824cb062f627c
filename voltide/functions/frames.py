"""Window helpers with the null rules of daily series: a window counts only when it is full."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def by_day() -> WindowSpec:
    """The rows of an instrument in order of days."""
    return Window.partitionBy("ticker").orderBy("dt")


def rows(first: int, last: int, by: WindowSpec | None = None) -> WindowSpec:
    return (by or by_day()).rowsBetween(first, last)


def full(aggregate, x: Column, first: int, last: int, by: WindowSpec | None = None) -> Column:
    """The aggregate of x over the rows first..last, null unless all of them are there and not null."""
    w = rows(first, last, by)
    return F.when(F.count(x).over(w) == last - first + 1, aggregate(x).over(w))


def forward_fill(x: Column, by: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over(rows(Window.unboundedPreceding, 0, by))


def back_fill(x: Column, by: WindowSpec | None = None) -> Column:
    return F.first(x, ignorenulls=True).over(rows(0, Window.unboundedFollowing, by))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limits that keep nulls (greatest and least alone would not)."""
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def significant(x: Column, digits: int = 8) -> Column:
    """x to so many significant digits, and none beyond the fifteenth decimal."""
    y = F.round(x.cast("double"), 15)
    return F.when(y.isNotNull() & ~F.isnan(y), F.format_string(f"%.{digits - 1}e", y).cast("double"))
