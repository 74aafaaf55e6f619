"""A declared catalog: tables with a type, a location and keys, published as views with what each type adds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """``kind`` is normal, orc, kv, kkv, summary or series; ``key`` is the primary or prefix key."""

    name: str
    location: str
    kind: str = "normal"
    key: str | None = None
    second_key: str | None = None
    detail: tuple[str, ...] = ()
    stamp: str | None = None


def _normal(spark: SparkSession, spec: TableSpec) -> DataFrame:
    return spark.read.parquet(spec.location)


def _keyed(spark: SparkSession, spec: TableSpec) -> DataFrame:
    if spec.key is None:
        raise ValueError(f"{spec.name} needs a key")
    return _normal(spark, spec)


READERS = {
    "normal": _normal,
    "orc": lambda spark, spec: spark.read.orc(spec.location),
    "kv": _keyed,
    "kkv": _keyed,
    "summary": _keyed,
    "series": _normal,
}


def load(spark: SparkSession, spec: TableSpec) -> DataFrame:
    if spec.kind not in READERS:
        raise ValueError(f"unknown table type {spec.kind}")
    return READERS[spec.kind](spark, spec)


def publish(spark: SparkSession, specs: list[TableSpec]) -> list[str]:
    """Create the views; a summary table adds ``<name>_summary_`` with its details, a series ``<name>_meta``."""
    made = []
    for spec in specs:
        rows = load(spark, spec)
        views = {spec.name: rows}
        if spec.kind == "summary":
            views[f"{spec.name}_summary_"] = rows.select(spec.key, *spec.detail)
        if spec.kind == "series":
            views[f"{spec.name}_meta"] = rows.groupBy(spec.key).agg(F.count(F.lit(1)).alias("points"), F.min(spec.stamp).alias("first"), F.max(spec.stamp).alias("last"))
        for name, df in views.items():
            df.createOrReplaceTempView(name)
            made.append(name)
    return made


@dataclass(frozen=True)
class MainAux:
    """A declared pair: every row of the main table with the auxiliary table's fields, by the key that is in both."""

    name: str
    main: TableSpec
    aux: TableSpec
    main_key: str

    def publish(self, spark: SparkSession) -> None:
        main, aux = load(spark, self.main), load(spark, self.aux)
        if self.aux.key is None or self.main_key not in main.columns or self.aux.key not in aux.columns:
            raise ValueError(f"{self.name} needs its key in both tables")
        aux = aux.withColumnRenamed(self.aux.key, "__key")
        main.join(aux, F.col(self.main_key) == F.col("__key"), "left").drop("__key").createOrReplaceTempView(self.name)


def limited(rows: DataFrame, n: int = 100) -> DataFrame:
    """The forced limit of a session that asks for one."""
    return rows.limit(n)


def formatted(rows: DataFrame, kind: str = "json"):
    """A result as ``json`` lines, one ``full_json`` document, an Arrow ``table``, or ``string`` lines.

    A formatted result is for a client, so it is what a query returns after its limit.
    """
    if kind == "json":
        return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    if kind == "string":
        return rows.select(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in rows.columns]), " | ").alias("value"))
    if kind == "table":
        return rows.toArrow()
    if kind == "full_json":
        return {"columns": rows.columns, "types": [t for _, t in rows.dtypes], "rows": [list(r) for r in rows.collect()]}
    raise ValueError(f"unknown format {kind}")
