"""Functions that SQL texts can call by name: scalar, aggregate and table functions, registered in a session."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Declared:
    """A catalog record: name, kind (udf, udaf, udtf), result type, and whether equal inputs give equal results."""

    name: str
    kind: str
    returns: str
    make: object
    deterministic: bool = True


def _bucket_of():
    @F.pandas_udf("int")
    def bucket_of(values: pd.Series, width: pd.Series) -> pd.Series:
        return (values // width).astype("Int32")

    return bucket_of


def _spread():
    """A pandas aggregate would gather each whole group in one Python task; two built-in ones combine before a shuffle."""
    return lambda values: F.max(values) - F.min(values)


def _split_pairs():
    @F.udtf(returnType="name string, value string")
    class SplitPairs:
        def eval(self, text: str, sep: str):
            for part in (text or "").split(sep):
                if part:
                    name, _, value = part.partition(":")
                    yield name, value

    return SplitPairs


CATALOG = (
    Declared("bucket_of", "udf", "int", _bucket_of),
    Declared("spread", "udaf", "double", _spread),
    Declared("split_pairs", "udtf", "name string, value string", _split_pairs),
)


def aggregate(name: str, *columns, catalog: tuple[Declared, ...] = CATALOG):
    """A declared aggregate over columns."""
    found = next((f for f in catalog if f.name == name and f.kind == "udaf"), None)
    if found is None:
        raise ValueError(f"unknown aggregate {name}")
    return found.make()(*[F.col(c) if isinstance(c, str) else c for c in columns]).cast(found.returns)


def register(spark: SparkSession, catalog: tuple[Declared, ...] = CATALOG) -> None:
    """Register every function that SQL texts can call; a name that is declared twice is an error.

    Aggregates are built of Spark's own and called through ``aggregate``.
    """
    names = [f.name for f in catalog]
    if len(set(names)) != len(names):
        raise ValueError("a function is declared twice")
    for function in catalog:
        if function.kind == "udaf":
            continue
        target = spark.udtf if function.kind == "udtf" else spark.udf
        target.register(function.name, function.make())
