"""Ranking table functions: top rows, rows per group, and quota reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import sort_keys


def rank_rows(rows: DataFrame, partition: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each partition in the order; tasks drop rows beyond ``n`` before the shuffle."""
    if n < 1:
        raise ValueError("n must be at least 1")
    window = Window.partitionBy(*partition).orderBy(*sort_keys(order))
    return rows.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def sort_rows(rows: DataFrame, order: str, n: int, offset: int = 0) -> DataFrame:
    """Ordered rows ``offset`` to ``offset + n``, as a bounded top-k."""
    return rows.orderBy(*sort_keys(order)).offset(offset).limit(n) if offset else rows.orderBy(*sort_keys(order)).limit(n)


def ordered(rows: DataFrame, order: str, n: int | None = None, offset: int = 0) -> DataFrame:
    """``sort_rows`` for a client's order: one without a limit is refused, since it would sort the whole table."""
    if n is None:
        raise ValueError("an order needs a limit")
    return sort_rows(rows, order, n, offset)


def mark_top(rows: DataFrame, order: str, n: int, key: str, out: str = "topKMark") -> DataFrame:
    """All rows, with a mark on the first ``n``.

    The marked keys are a top-k of at most ``n`` rows, joined back: no window over the whole table.
    """
    top = sort_rows(rows, order, n).select(key).withColumn(out, F.lit(True))
    return rows.join(top, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def quota_rerank(rows: DataFrame, field: str, quotas: dict[str, int], order: str, total: int | None = None) -> DataFrame:
    """The best rows of each value of ``field`` up to its quota, and then the best of the rest up to ``total``.

    Rows of values without a quota count as rest. ``quota_row`` tells rows within quota from those made up.
    """
    limit = F.lit(0)
    for value, n in quotas.items():
        limit = F.when(F.col(field) == value, n).otherwise(limit)
    total = sum(quotas.values()) if total is None else total
    window = Window.partitionBy(field).orderBy(*sort_keys(order))
    # no value can need more rows than the whole result has
    ranked = rows.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= max(total, 1))
    marked = ranked.withColumn("quota_row", F.col("__rank") <= limit)
    return marked.orderBy(F.col("quota_row").desc(), *sort_keys(order)).limit(total).drop("__rank")


def spare_quota_rerank(rows: DataFrame, field: str, quotas: dict[str, int], order: str) -> DataFrame:
    """Like a quota per value, but quota that a value can't use goes to the others that have rows left, best rows first.

    Only counts of the quota's values reach the driver.
    """
    counts = {r[field]: r["n"] for r in rows.where(F.col(field).isin(list(quotas))).groupBy(field).agg(F.count(F.lit(1)).alias("n")).collect()}
    spare = sum(max(0, n - counts.get(v, 0)) for v, n in quotas.items())
    limit = F.lit(0)
    for value, n in quotas.items():
        limit = F.when(F.col(field) == value, n).otherwise(limit)
    window = Window.partitionBy(field).orderBy(*sort_keys(order))
    ranked = rows.where(F.col(field).isin(list(quotas))).withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= limit + spare)
    within = ranked.where(F.col("__rank") <= limit)
    extra = ranked.where(F.col("__rank") > limit).orderBy(*sort_keys(order)).limit(spare)
    return within.unionByName(extra).drop("__rank")


def window_rerank(rows: DataFrame, field: str, order: str, size: int, most: int, n: int) -> DataFrame:
    """The best ``n`` rows dealt into windows of ``size`` rows with at most ``most`` of one value in each.

    The k-th row of a value belongs to window ``k / most`` at the earliest; rows are ordered by that, then by rank.
    """
    top = sort_rows(rows, order, n)
    own = Window.partitionBy(field).orderBy(*sort_keys(order))
    dealt = top.withColumn("__turn", F.floor((F.row_number().over(own) - 1) / most))
    # at most n rows are left, so one window over them is bounded
    place = Window.orderBy("__turn", *sort_keys(order))
    return dealt.withColumn("place", F.row_number().over(place)).withColumn("window", F.floor((F.col("place") - 1) / size)).drop("__turn")
