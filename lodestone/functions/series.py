"""Time series: downsampling, rates and tag filters over rows of (stamp, tags, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aggregates that a step's points may be reduced by.
REDUCERS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def tagged(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows whose tags pass: ``a|b`` lists values, ``!a|b`` excludes them, ``*`` asks for any value."""
    for name, wanted in filters.items():
        values = wanted.lstrip("!").split("|")
        held = F.col(name).cast("string")
        passes = held.isNotNull() if wanted == "*" else ~held.isin(values) if wanted.startswith("!") else held.isin(values)
        rows = rows.where(passes)
    return rows


def downsampled(rows: DataFrame, stamp: str, tags: list[str], value: str, step: str, by: str = "avg") -> DataFrame:
    """(tags, start, value): the points of each step of each series reduced to one, partly before the shuffle."""
    if by not in REDUCERS:
        raise ValueError(f"unknown reducer {by}")
    return rows.groupBy(*tags, F.window(stamp, step)["start"].alias("start")).agg(REDUCERS[by](value).alias(value))


def rate(rows: DataFrame, stamp: str, tags: list[str], value: str) -> DataFrame:
    """``rows`` with the change of ``value`` a second since the point before in the series; null at its first point.

    A series is ordered by one task, so downsample a very long one first.
    """
    own = Window.partitionBy(*tags).orderBy(stamp)
    seconds: Column = F.unix_timestamp(stamp) - F.unix_timestamp(F.lag(stamp).over(own))
    return rows.withColumn("rate", (F.col(value) - F.lag(value).over(own)) / seconds)
