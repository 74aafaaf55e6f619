"""Streams: filtered feeds, event-time windows, and upserts by primary key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import dml
from lodestone.session import scratch


def events_of(spark: SparkSession, sf_dir: str, name: str = "events", files: int = 4) -> DataFrame:
    """A table's folder as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there, run through the stream once into Parquet and read back."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(stream: DataFrame, stamp: str, key: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and key; windows close when the watermark passes them."""
    window = F.window(stamp, length, slide) if slide else F.window(stamp, length)
    stream = stream.withColumn(stamp, F.col(stamp).cast("timestamp"))  # a watermark needs an instant, not a local time
    return stream.withWatermark(stamp, late).groupBy(window, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def upserted(spark: SparkSession, commands: DataFrame, base: DataFrame, key: str, order: str) -> DataFrame:
    """The table after a stream of commands, micro-batch by micro-batch; each batch writes a new version."""
    table = VersionedTable(spark, scratch(spark, "versions"), base)
    query = commands.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number, key, order)).option("checkpointLocation", scratch(spark, "upsert-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()


class VersionedTable:
    """A table at ``root`` with a folder for each version; version n is what batch n - 1 of a stream left.

    A batch always starts from the last version before its own, as the folders tell, and overwrites its own. So a batch
    that is repeated, by this driver or by one that starts again with the stream's checkpoint, gives the same version,
    and each command is applied exactly once. A version without the writer's mark of success doesn't count.
    """

    def __init__(self, spark: SparkSession, root: str, base: DataFrame):
        self.spark, self.root, self.schema = spark, root, base.schema
        if not self.versions():
            base.write.mode("overwrite").parquet(self._path(0))

    def _path(self, version: int) -> str:
        return f"{self.root}/version-{version:020d}"

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = store.listStatus(root) if store.exists(root) else []
        paths = [x.getPath() for x in found if x.getPath().getName().startswith("version-")]
        return sorted(int(p.getName()[8:]) for p in paths if store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def apply(self, batch: DataFrame, number: int, key: str, order: str) -> None:
        before = max(v for v in self.versions() if v <= number)
        rows = batch.sparkSession.read.schema(self.schema).parquet(self._path(before))
        dml.applied(rows, batch, key, order).write.mode("overwrite").parquet(self._path(number + 1))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._path(self.versions()[-1]))


def progress(query: StreamingQuery) -> dict:
    """How far a stream has read: batches, rows, and where its sources stand, from what it last reported."""
    reports = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    last = reports[-1] if reports else {"batchId": -1, "sources": []}
    return {"batch": last["batchId"], "rows": sum(p["numInputRows"] for p in reports), "offsets": [s["endOffset"] for s in last["sources"]]}


def wait_until_fresh(query: StreamingQuery, target: str | None = None, seconds: float = 30.0) -> bool:
    """Wait until all data there now are processed, or until the event-time watermark reaches ``target``.

    Waiting for a target on a query without a watermark is an error; False if the time runs out.
    """
    import time

    if target is None:
        query.processAllAvailable()
        return True
    until = time.monotonic() + seconds
    while time.monotonic() < until:
        progress = query.lastProgress
        if progress is not None:
            event_time = dict(progress["eventTime"] if isinstance(progress, dict) else progress.eventTime)
            if "watermark" not in event_time:
                raise RuntimeError("the query has no watermark")
            if event_time["watermark"] >= target:
                return True
        time.sleep(0.2)
    return False
