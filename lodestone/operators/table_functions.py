"""Table functions by name: each takes a frame and its arguments and gives a frame."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import ranking, tables

log = logging.getLogger(__name__)
#: What was counted by ``table_metric``, by tag.
METRICS: dict[str, Observation] = {}


def identity(rows: DataFrame) -> DataFrame:
    return rows


def print_table(rows: DataFrame, n: int = 10) -> DataFrame:
    """The rows as they are; the first ``n`` of them go to the log, fetched by a job of their own."""
    if n < 0:
        raise ValueError("n must not be negative")
    log.info("%s\n%s", " | ".join(rows.columns), "\n".join(" | ".join(map(str, r)) for r in rows.limit(n).collect()))
    return rows


def table_metric(rows: DataFrame, tag: str) -> DataFrame:
    """The rows as they are; once they have been computed, ``METRICS[tag].get`` has their number."""
    METRICS[tag] = Observation(f"{tag}-{len(METRICS)}")
    return rows.observe(METRICS[tag], F.count(F.lit(1)).alias("rows"))


FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "identityTvf": identity,
    "printTableTvf": print_table,
    "tableMetricTvf": table_metric,
    "rankTvf": lambda rows, partition, order, n: ranking.rank_rows(rows, partition.split(","), order, n),
    "sortTvf": lambda rows, order, n: ranking.sort_rows(rows, order, n),
    "unpackMultiValue": lambda rows, fields: tables.unpack_multi_value(rows, *fields.split(",")),
    "transRows": tables.trans_rows,
}


def call(name: str, rows: DataFrame, *arguments) -> DataFrame:
    """The result of the function of that name; functions of a caller's own may be added to FUNCTIONS."""
    if name not in FUNCTIONS:
        raise ValueError(f"unknown table function {name}")
    return FUNCTIONS[name](rows, *arguments)
