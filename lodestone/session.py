"""Session defaults and table access shared by the query modules."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = 8, name: str = "lodestone", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Parquet keeps its schema, so nothing is inferred from rows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets one of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = f"file:///tmp/checkpoints/lodestone-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths that ``scratch`` has given out and that haven't been removed.
_given: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. What is written there stays until ``clear_scratch`` is called."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def clear_scratch(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Remove all tables that operators wrote below the shared folder in this process, but for the paths in ``keep``.

    Results that are read lazily from them must have been written elsewhere before.
    """
    held = [path for path in _given if path in keep]
    for path in _given:
        if path not in held:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _given[:] = held
