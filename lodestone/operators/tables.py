"""Table kinds: multi-value columns, split rows, inline tables, layers, key-value views, sub-tables, aggregation tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import scratch


def unpack_multi_value(rows: DataFrame, *fields: str) -> DataFrame:
    """One row for each element of each named array; an empty or null array keeps its row with a null."""
    for name in fields:
        rows = rows.withColumn(name, F.explode_outer(name))
    return rows


def trans_rows(rows: DataFrame, field: str, sep: str = ":") -> DataFrame:
    """Split ``field`` at the first separator into ``trans_cola`` and ``trans_colb``; a missing part is empty."""
    sep = sep or ":"
    value = F.coalesce(F.col(field), F.lit(""))
    at = F.locate(sep, value)
    first = F.when(at > 0, F.substring(value, F.lit(1), at - 1)).otherwise(value)
    second = F.when(at > 0, F.substring(value, at + len(sep), F.length(value))).otherwise("")
    return rows.withColumns({"trans_cola": first, "trans_colb": second})


def input_table(spark: SparkSession, text: str, schema: str, row_sep: str = ";", column_sep: str = ",", value_sep: str = ":") -> DataFrame:
    """A table from a delimited string. Array columns are split at ``value_sep``; values are cast to the schema."""
    names = spark.createDataFrame([], schema).schema
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", f"\\Q{row_sep}\\E")).alias("row")).where("row != ''")
    parts = F.split("row", f"\\Q{column_sep}\\E")
    columns = []
    for i, field in enumerate(names):
        value = F.get(parts, i)
        kind = field.dataType.simpleString()
        value = F.split(value, f"\\Q{value_sep}\\E").cast(kind) if kind.startswith("array") else value.try_cast(kind)
        columns.append(value.alias(field.name))
    return rows.select(*columns)


def layered(parts: list[tuple[DataFrame, Column]], key: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """The union of layers, each narrowed to its own range; with ``key``, one row of each key, the first in ``order``."""
    whole = reduce(DataFrame.unionByName, [df.where(own) for df, own in parts])
    if key is None:
        return whole
    window = Window.partitionBy(key).orderBy(*(order or [F.col(key)]))
    return whole.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def key_lookup(rows: DataFrame, key: str, values: list) -> DataFrame:
    """Rows of the given primary keys, pushed to the scan as an IN filter. A lookup without keys is an error."""
    if not values:
        raise ValueError("a key-value table is read by its key only")
    return rows.where(F.col(key).isin(values))


def prefix_lookup(rows: DataFrame, key: str, values: list, second: str, n: int | None = None) -> DataFrame:
    """Rows of the given prefix keys in the order of the second key, at most ``n`` of each."""
    found = key_lookup(rows, key, values)
    if n is None:
        return found
    window = Window.partitionBy(key).orderBy(second)
    return found.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def nested(parents: DataFrame, children: DataFrame, key: str, out: str, order: list[str]) -> DataFrame:
    """Parents with their children as an array of structs. Children of one parent are expected to fit in a row."""
    fields = [*order, *[c for c in children.columns if c not in (key, *order)]]
    held = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))
    return parents.join(held, key, "left")


def unnest(parents: DataFrame, array: str, outer: bool = False) -> DataFrame:
    """One row for each child; with ``outer`` a parent without children stays."""
    exploded = (F.explode_outer if outer else F.explode)(array).alias("__child")
    return parents.select(*[c for c in parents.columns if c != array], exploded).select("*", "__child.*").drop("__child")


def aggregation_table(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])


class AggregationTable:
    """An aggregate of a table that is computed once, written in the order of its keys, and asked by key."""

    def __init__(self, rows: DataFrame, keys: list[str], measures: dict[str, Column]):
        self.keys, self.measures = keys, list(measures)
        path = scratch(rows.sparkSession, "aggregation")
        found = aggregation_table(rows, keys, measures)
        found.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
        self.rows = rows.sparkSession.read.schema(found.schema).parquet(path)

    def answer(self, equal: dict, ranged: dict[str, tuple] | None = None, needed: list[str] | None = None) -> DataFrame:
        """Rows with the keys in ``equal`` and measures within ``ranged`` (low, high); refused if they don't cover it."""
        ranged, needed = ranged or {}, needed or [*self.keys, *self.measures]
        if not covers(set(self.keys), set(self.measures), set(equal), set(ranged), set(needed)):
            raise ValueError("the aggregation table doesn't cover the query")
        found = self.rows
        for name, value in equal.items():
            found = found.where(F.col(name) == value)
        for name, (low, high) in ranged.items():
            found = found.where(F.col(name).between(low, high))
        return found.select(*needed)


def covers(keys: set[str], values: set[str], equal: set[str], ranged: set[str], needed: set[str]) -> bool:
    """Whether an aggregation table answers a query: equalities on all its keys, ranges on values, every field held."""
    return equal == keys and ranged <= values and needed <= keys | values
