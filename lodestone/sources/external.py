"""Tables of other systems, read through JDBC with filters and columns pushed down."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Keys of a lookup that are sent along with the query at most; more are joined after a scan.
MOST_KEYS = 1000


@dataclass(frozen=True)
class External:
    """A table behind a JDBC url. With ``column``, ``low`` and ``high`` a scan is split into ``parts`` by that column."""

    url: str
    table: str
    column: str | None = None
    low: int | None = None
    high: int | None = None
    parts: int = 8
    options: dict = field(default_factory=dict)


def scan(spark: SparkSession, source: External) -> DataFrame:
    """The table as a frame: what is selected and filtered next reaches the other system as SQL."""
    reader = spark.read.format("jdbc").option("url", source.url).option("dbtable", source.table).options(**source.options)
    if source.column is not None:
        reader = reader.option("partitionColumn", source.column).option("lowerBound", source.low).option("upperBound", source.high).option("numPartitions", source.parts)
    return reader.load()


def lookup_join(probe: DataFrame, source: External, key: str, how: str = "inner") -> DataFrame:
    """Join ``probe`` with the rows of the other system that have its keys.

    Up to MOST_KEYS distinct keys are sent as a filter, so only their rows are read; with more the table is scanned.
    """
    keys = [r[0] for r in probe.where(probe[key].isNotNull()).select(key).distinct().limit(MOST_KEYS + 1).collect()]
    rows = scan(probe.sparkSession, source)
    if len(keys) <= MOST_KEYS:
        rows = rows.where(rows[key].isin(keys))
    return probe.join(rows, key, how)
