"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import scratch, shared_dir  # noqa: F401

#: A key with over one in this many rows of a join is dealt out over several tasks; so at most as many keys are.
HOT_SHARE = 200
#: Bytes of one Arrow batch at most: whole texts are long, and a batch is held several times.
BATCH_BYTES = 8 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uri(path: str) -> str:
    """``path`` as ``pyarrow.fs`` takes it: Spark writes local ones with one slash."""
    return "file:///" + path[len("file:"):].lstrip("/") if path.startswith("file:") else path


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ``BATCH_BYTES`` at most, or one row if that is longer.

    The setting is read when a plan runs, which may be after the operator has returned, so it is left in the session.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    number = int(held.rstrip("bB")) if held.rstrip("bB").lstrip("-").isdigit() else -1
    if not 0 < number <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal ``df`` out by ``columns`` over as many tasks as a shuffle has, which adaptive execution leaves as they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "left", count: str = "n", total: int | None = None) -> DataFrame:
    """Equi-join whose ``key`` may be hot on the left and is unique on the right.

    ``right`` is a written table whose column ``count`` tells how many rows of the left have the key; it goes unless
    ``total`` is given, which says how many rows there are. Keys over a HOT_SHARE of all rows are dealt into parts by the
    hash of ``spread``, as many as the key's share asks for, and the right row is copied to each. At most HOT_SHARE keys
    are hot, so their table is broadcast.
    """
    if total is None:
        total = right.agg(F.sum(count)).first()[0] or 0
    step = max(1, total // HOT_SHARE)
    parts = F.ceil(F.col(count) / step).cast("int")
    hot = right.where(F.col(count) > step).select(key, parts.alias("__parts"))
    salt = F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")), F.lit(0)).cast("int")
    left = left.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__parts")
    copies = F.when(F.col(count) > step, parts).otherwise(1)
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop(count)
    return left.join(right, [key, "__salt"], how).drop("__salt")


def salt_of(col: Column | str, salts: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(salts)).cast("int")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ids_repeat(docs: DataFrame) -> bool:
    """Whether several rows of ``docs`` have one doc_id."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def staying(docs: DataFrame, marks: DataFrame, key: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``marks`` (doc_id, kept, and key if one is given) lets stay, with all their columns.

    ``marks`` is a written table with a row for each row of ``docs``, and ``key`` gives its key from a row of ``docs``.
    Of rows that agree in doc_id and key one stays at most. A row without doc_id stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns go by place, so that names may clash
    own = ["id"] if key is None else ["id", "key"]
    marks = marks.where("doc_id is not null").withColumnRenamed("doc_id", "id")
    rows = docs.withColumn("__key", F.lit(0) if key is None else key).toDF(*names, "key").withColumn("id", F.col(names[docs.columns.index("doc_id")]))
    rows = rows.join(marks.where("not kept").select(own), own, "left_anti")
    if not marks.where("kept").groupBy(own).count().where("count > 1").isEmpty():
        rows = rows.where("id is null").unionByName(rows.where("id is not null").dropDuplicates(own))
    return rows.select(names).toDF(*docs.columns)
