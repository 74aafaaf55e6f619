"""Changes to tables: copy on write over Parquet, with commands that add, update or delete by primary key."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADD, UPDATE, DELETE = "add", "update_field", "delete"


def inserted(rows: DataFrame, new: DataFrame) -> DataFrame:
    return rows.unionByName(new.select(rows.columns))


def updated(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    changed = {c: F.when(condition, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    return rows.withColumns(changed)


def deleted(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; an unknown condition deletes nothing."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def keys_of(condition: str, key: str) -> list[str]:
    """The values that the condition of an UPDATE or DELETE gives for its primary key, by ``=`` or ``IN``.

    A change is routed by its key, so a condition without one is refused. Quotes are taken off; other conditions joined
    by AND may stand beside it, but none by OR.
    """
    if re.search(r"\bor\b", re.sub(r"'(?:[^']|'')*'", "''", condition), re.IGNORECASE):
        raise ValueError("a condition with OR doesn't give the keys")
    value = r"('(?:[^']|'')*'|-?\d+)"
    one = re.search(rf"(?<![\w.`]){re.escape(key)}\s*=\s*{value}", condition, re.IGNORECASE)
    several = re.search(rf"(?<![\w.`]){re.escape(key)}\s+in\s*\(\s*({value}(?:\s*,\s*{value})*)\s*\)", condition, re.IGNORECASE)
    if one is None and several is None:
        raise ValueError(f"the condition doesn't give {key}")
    found = [one[1]] if one else re.findall(value, several[1])
    return [x[1:-1].replace("''", "'") if x.startswith("'") else x for x in found]


def patched(rows: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with the newest value that any of ``patches`` (key, order, some of the columns) holds for each attribute.

    Patches of rows that aren't there are dropped; a null in a patch holds nothing.
    """
    fields = [c for c in patches.columns if c not in (key, order)]
    newest = patches.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f"__{f}") for f in fields])
    merged = {f: F.coalesce(F.col(f"__{f}").cast(rows.schema[f].dataType), F.col(f)) for f in fields}
    return rows.join(newest, key, "left").withColumns(merged).select(rows.columns)


def compacted(spark: SparkSession, segments: list[str], path: str, key: str, order: str) -> DataFrame:
    """Merge segments, folders of rows, into one at ``path``: the newest row of each key, sorted by key."""
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(s) for s in segments])
    fields = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("__row")).select(key, "__row.*").select(rows.columns)
    newest.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
    return spark.read.parquet(path)


def row_count(rows: DataFrame, condition: Column | None = None) -> DataFrame:
    """The ROWCOUNT row of a change."""
    rows = rows if condition is None else rows.where(condition)
    return rows.agg(F.count(F.lit(1)).alias("ROWCOUNT"))


def applied(rows: DataFrame, commands: DataFrame, key: str, order: str, command: str = "cmd") -> DataFrame:
    """``rows`` after ``commands`` (key, order, command and any of the columns), applied in order for each key.

    An add replaces the row, an update sets the fields that it holds (nulls are not held) and does nothing without a
    row, a delete removes it. Only commands since the last add or delete of a key matter, and updates fold by the last
    value of each field: two aggregates, which combine before they shuffle, and two joins, however many commands a key has.
    """
    fields = [c for c in rows.columns if c != key]
    bases = commands.where(F.col(command) != UPDATE).groupBy(F.col(key).alias("__key")).agg(F.max(order).alias("__base"))
    live = commands.join(bases, F.col(key) == F.col("__key"), "left").where(F.col("__base").isNull() | (F.col(order) >= F.col("__base")))
    folded = live.groupBy(key).agg(
        F.max_by(command, order).alias("__last"),
        F.min_by(command, order).alias("__first"),
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f"__{f}") for f in fields],
    )
    met = rows.withColumn("__row", F.lit(True)).join(folded, key, "full")
    exists = F.when(F.col("__first").isNull(), F.lit(True)).when(F.col("__first") == ADD, F.lit(True)).when(F.col("__first") == DELETE, F.lit(False)).otherwise(F.col("__row").isNotNull())
    replaced = F.coalesce(F.col("__first") == ADD, F.lit(False))
    values = [F.when(replaced, F.col(f"__{f}")).otherwise(F.coalesce(F.col(f"__{f}"), F.col(f))).cast(rows.schema[f].dataType).alias(f) for f in fields]
    return met.where(exists).select(key, *values).select(rows.columns)


def applied_to(path: str, rows: DataFrame, commands: DataFrame, key: str, order: str, command: str = "cmd") -> DataFrame:
    """Write ``rows`` after ``commands`` as the table at ``path``, which mustn't be where ``rows`` are read from."""
    applied(rows, commands, key, order, command).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
