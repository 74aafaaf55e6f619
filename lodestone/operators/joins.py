"""Joins of the search dialect. Catalyst picks the physical join; nothing is broadcast but by its measured size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each side that a tile of a range join has, and the tasks that its tiles are dealt to, at most.
LEFT, RIGHT, TASKS = 4000, 4000, 20_000

def equi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equality on pairs of columns with an optional residual condition. Full joins aren't part of the dialect."""
    if how not in ("inner", "left", "right", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    condition = residual if residual is not None else F.lit(True)
    for a, b in keys:
        condition = (left[a] == right[b]) & condition
    return left.join(right, condition, how)


def left_join_with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join whose rows without a match get ``defaults`` in the right's columns; matched nulls stay null."""
    marked = right.withColumn("__met", F.lit(True))
    joined = left.join(marked, key, "left")
    filled = {c: F.when(F.col("__met").isNull(), F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()}
    return joined.withColumns(filled).drop("__met")


def lookup_join(probe: DataFrame, build: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Point lookups of the probe's keys in a build table: one join, which the adaptive planner turns into a broadcast
    of whichever side is small, or prunes the larger by a runtime filter on the keys."""
    return probe.join(build, key, how)


def not_in(left: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """``column NOT IN (SELECT value FROM values)`` with SQL's nulls: a null among the values leaves nothing, and a null
    on the left stays only if there are no values.

    The values are looked through once for a null; the join itself is a plain anti join, which needs no broadcast.
    """
    seen = values.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("known")).first()
    if not seen["n"]:
        return left
    if seen["known"] < seen["n"]:
        return left.limit(0)
    return left.where(F.col(column).isNotNull()).join(values.select(F.col(value).alias("__value")).distinct(), F.col(column) == F.col("__value"), "left_anti")


def multicast_join(left: DataFrame, array: str, right: DataFrame, right_key: str) -> DataFrame:
    """Membership join: rows of the right whose key is an element of the left's array, by an equality on elements."""
    elements = left.withColumn("__element", F.explode(F.array_distinct(array)))
    return elements.join(right, F.col("__element") == right[right_key]).drop("__element")


def left_multi_join(left: DataFrame, key: str, array: str, right: DataFrame, right_key: str, value: str, out: str) -> DataFrame:
    """Look up every element of an array and gather the found values in the order of the elements; misses are null.

    Rows are told apart by key and array, so a key may repeat with other arrays.
    """
    rows = left.select(key, F.col(array).alias("__own")).distinct()
    elements = rows.select(key, "__own", F.posexplode_outer("__own").alias("__at", "__element"))
    found = elements.join(right.select(F.col(right_key).alias("__element"), F.col(value).alias("__value")), "__element", "left")
    held = F.collect_list(F.when(F.col("__at").isNotNull(), F.struct("__at", "__value")))
    gathered = found.groupBy(key, "__own").agg(F.transform(F.sort_array(held), lambda x: x["__value"]).alias(out))
    gathered = gathered.withColumnRenamed(key, "__key")
    return left.join(gathered, F.col(key).eqNullSafe(F.col("__key")) & F.col(array).eqNullSafe(F.col("__own")), "left").drop("__key", "__own")


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner", most: int = 10_000) -> DataFrame:
    """Join on any condition. Only a right side that is counted to have at most ``most`` rows is broadcast; a larger one
    is refused, since every pair would have to be looked at: use an equality or ``range_join``."""
    if right.limit(most + 1).count() > most:
        raise ValueError(f"the right side has over {most} rows")
    return left.join(F.broadcast(right), condition, how)


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows whose value lies in [low, high), by an equality on buckets of ``width`` instead of a nested loop.

    Crowded buckets are dealt into tiles of about LEFT and RIGHT rows: a row has one part of its own side, by its hash, and
    is copied to each part of the other. So for larger tables, or a frequent value, there are more tasks, not longer ones.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    spread = right.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    rows = left.withColumn("__bucket", bucket(F.col(value)))
    n, m = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")), spread.groupBy("__bucket").agg(F.count(F.lit(1)).alias("m"))
    parts = [F.ceil(F.col(c) / F.lit(most)).cast("int").alias(c) for c, most in (("n", LEFT), ("m", RIGHT))]
    sizes = n.join(m, "__bucket")
    # at most one bucket for every LEFT or RIGHT rows
    crowded = sizes.where((F.col("n") > LEFT) | (F.col("m") > RIGHT)).select(F.col("__bucket"), F.struct(*parts).alias("__parts"))
    pairs = sizes.where((F.col("n") > LEFT) | (F.col("m") > RIGHT)).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    keys = ["__bucket"]
    if pairs:
        keys += ["__n", "__m"]
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(pairs / (LEFT * RIGHT)), TASKS))

        def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
            count = lambda c: F.coalesce(F.col("__parts")[c], F.lit(1))
            hashed = F.xxhash64(*[c for c in side.columns if c != "__bucket"])
            side = side.join(F.broadcast(crowded), "__bucket", "left").withColumn(f"__{own}", F.pmod(hashed, count(own)).cast("int"))
            return side.withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), count(other) - 1))).drop("__parts").repartition(tasks, *keys)

        rows, spread = dealt(rows, "n", "m"), dealt(spread, "m", "n").hint("shuffle_hash")
    met = rows.join(spread, keys)
    return met.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop(*keys)
