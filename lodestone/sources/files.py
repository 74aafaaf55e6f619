"""File formats of document feeds, and message topics kept in folders."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a field, a document, and a value of a multi-value field.
FIELD_END, DOCUMENT_END, VALUE_END = "\x1f", "\x1e", "\x1d"

MESSAGE = "payload binary, stamp timestamp, hash int, mask int"


def read_documents(spark: SparkSession, path: str, fields: dict[str, str], command: str = "CMD") -> DataFrame:
    """Documents of ``k=v`` fields. ``fields`` maps names to types; array types are split into values.

    Files are split at document ends by the text reader; compressed files are read by their extension.
    """
    raw = spark.read.option("lineSep", DOCUMENT_END).text(path)
    text = F.regexp_replace("value", f"^[\\r\\n]+|{FIELD_END}[\\r\\n]*$", "")
    pairs = F.filter(F.split(text, f"{FIELD_END}[\\r\\n]*"), lambda p: F.contains(p, F.lit("=")))
    # each name once: the last of repeated fields counts
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.locate("=", p) + 1, F.length(p)).alias("v")))
    found = raw.select(entries.alias("e")).where(F.size("e") > 0)

    def value(name):
        own = F.filter("e", lambda x: x["k"] == name)
        return F.get(own, F.size(own) - 1)["v"]

    columns = [value(command).alias(command)]
    for name, kind in fields.items():
        held = value(name)
        columns.append((F.split(held, VALUE_END).cast(kind) if kind.startswith("array") else held.try_cast(kind)).alias(name))
    return found.select(*columns)


def write_documents(rows: DataFrame, path: str, command: str = "add", compression: str = "none") -> None:
    parts = [F.lit(f"CMD={command}{FIELD_END}\n")]
    for field in rows.schema:
        held = F.array_join(F.col(field.name).cast("array<string>"), VALUE_END) if field.dataType.typeName() == "array" else F.col(field.name).cast("string")
        parts.append(F.when(held.isNotNull(), F.concat(F.lit(f"{field.name}="), held, F.lit(f"{FIELD_END}\n"))).otherwise(""))
    lines = rows.select(F.concat(*parts).alias("value"))
    lines.write.option("lineSep", f"{DOCUMENT_END}\n").option("compression", compression).text(path)


def export_documents(rows: DataFrame, path: str, condition: Column | None = None, fields: list[str] | None = None) -> None:
    """Write a table's rows as a feed: those that meet the condition, with the named fields."""
    rows = rows if condition is None else rows.where(condition)
    write_documents(rows.select(*fields) if fields else rows, path)


def read_separated(spark: SparkSession, path: str, fields: dict[str, str], field_sep: str = "\t", line_sep: str = "\n", value_sep: str = VALUE_END) -> DataFrame:
    """Lines of fields by place, with a feed's own separators; array types are split into values. Short lines give nulls."""
    parts = F.split("value", rf"\Q{field_sep}\E")
    columns = []
    for i, (name, kind) in enumerate(fields.items()):
        held = F.get(parts, i)
        columns.append((F.split(held, rf"\Q{value_sep}\E").cast(kind) if kind.startswith("array") else held.try_cast(kind)).alias(name))
    return spark.read.option("lineSep", line_sep).text(path).select(*columns)


#: Bytes of a file that one row of a task list stands for.
RANGE_BYTES = 32 << 20


def _ranges(spark: SparkSession, path: str, step: int | None) -> DataFrame:
    """(path, at, to, length) of the pieces of every file below ``path``; whole files without ``step``. No content is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    if step is None:
        return files.select("path", F.lit(0).cast("long").alias("at"), F.col("length").alias("to"), "length").repartition("path")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long")))
    ranges = files.select("path", "length", starts.alias("at"))
    return ranges.select("path", "at", F.least(F.col("at") + step, "length").alias("to"), "length").repartition("path", "at")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:") else path)


def read_fixed_records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(path, at, record) for each ``width`` bytes of each file, ``at`` counting from 0; a shorter rest is left out.

    Tasks read byte ranges of whole records, so a file of any size is split and none has to fit in a row.
    """
    step = max(1, RANGE_BYTES // width) * width

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                store, name = _store(task["path"])
                with store.open_input_file(name) as file:
                    for start in range(task["at"], task["to"], max(1, (1 << 20) // width) * width):
                        data = file.read_at(min(max(1, (1 << 20) // width) * width, task["to"] - start), start)
                        records = [data[i : i + width] for i in range(0, len(data) - width + 1, width)]
                        places = range(start // width, start // width + len(records))
                        yield pa.RecordBatch.from_pydict({"path": pa.array([task["path"]] * len(records), pa.string()), "at": pa.array(places, pa.int64()), "record": pa.array(records, pa.binary())})

    return _ranges(spark, path, step).mapInArrow(cut, "path string, at long, record binary")


def read_length_prefixed_records(spark: SparkSession, path: str, prefix: int = 4) -> DataFrame:
    """(path, at, record) of files whose records follow their length, a little-endian number of ``prefix`` bytes.

    Where a record starts is only known from those before it, so a file is one task's stream; files are spread over
    tasks. A record that the file's end cuts off is an error.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                store, name = _store(task["path"])
                with store.open_input_stream(name) as file:
                    number, held, size = 0, [], 0
                    while head := file.read(prefix):
                        length = int.from_bytes(head, "little")
                        record = file.read(length)
                        if len(head) < prefix or len(record) < length:
                            raise EOFError(f"{task['path']} ends inside a record")
                        held.append(record)
                        size += length
                        if size > 4 << 20 or len(held) >= 4096:
                            yield _records(task["path"], number, held)
                            number, held, size = number + len(held), [], 0
                    if held:
                        yield _records(task["path"], number, held)

    return _ranges(spark, path, None).mapInArrow(cut, "path string, at long, record binary")


def _records(path: str, first: int, records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array([path] * len(records), pa.string()), "at": pa.array(range(first, first + len(records)), pa.int64()), "record": pa.array(records, pa.binary())})


def write_encrypted(rows: DataFrame, path: str, column: str, key: str, compress: bool = False, lines: int = 10_000) -> None:
    """Write the texts of ``column`` to AES-encrypted blocks of about ``lines`` lines, compressed before that if asked.

    A block is a row of a Parquet file, so that a feed of any size is read in pieces.
    """
    spread = rows.select(F.col(column).alias("line"), F.floor(F.monotonically_increasing_id() / lines).alias("block"))
    blocks = spread.groupBy("block").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    body = F.col("text").cast("binary")
    if compress:
        body = gzipped(body)
    blocks.select(F.aes_encrypt(body, F.lit(key).cast("binary")).alias("secret"), F.lit(compress).alias("compressed")).write.parquet(path)


def read_encrypted(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(line) of the blocks that ``write_encrypted`` wrote; a wrong key is an error."""
    body = F.aes_decrypt("secret", F.lit(key).cast("binary"))
    text = F.coalesce(gunzipped(F.when(F.col("compressed"), body)), body).cast("string")
    return spark.read.parquet(path).select(F.explode(F.split(text, "\n")).alias("line"))


def read_encrypted_files(spark: SparkSession, path: str, key: str, compressed: bool = False) -> DataFrame:
    """(path, text) of files that are AES-encrypted as a whole, compressed before that or not; each fits in a row."""
    body = F.aes_decrypt("content", F.lit(key).cast("binary"))
    return spark.read.format("binaryFile").load(path).select("path", (gunzipped(body) if compressed else body).cast("string").alias("text"))


def gzipped(body: Column) -> Column:
    return _gzip()(body)


def gunzipped(body: Column) -> Column:
    return _gunzip()(body)


@cache
def _gzip():
    return F.udf(lambda x: None if x is None else gzip.compress(x), "binary", useArrow=True)


@cache
def _gunzip():
    return F.udf(lambda x: None if x is None else gzip.decompress(x), "binary", useArrow=True)


def append_messages(rows: DataFrame, topic: str, key: str, stamp: str, ranges: int = 8) -> None:
    """Append rows to a topic as JSON payloads, in a folder for each hash range so that readers skip what isn't theirs."""
    from lodestone.operators.documents import topic_hash

    hashed = topic_hash(F.col(key))
    messages = rows.select(
        F.to_json(F.struct(*rows.columns)).cast("binary").alias("payload"), F.col(stamp).alias("stamp"), hashed.alias("hash"), F.lit(0).alias("mask")
    ).withColumn("part", F.floor(F.col("hash") / (65536 // ranges)).cast("int"))
    messages.write.mode("append").partitionBy("part").parquet(topic)


def read_messages(spark: SparkSession, topic: str, schema: str, low: int = 0, high: int = 65535, ranges: int = 8) -> DataFrame:
    """Rows of the messages whose hash lies in [low, high]; other ranges' folders aren't read."""
    width = 65536 // ranges
    found = spark.read.parquet(topic).where(F.col("part").between(low // width, high // width) & F.col("hash").between(low, high))
    return found.select(F.from_json(F.col("payload").cast("string"), schema).alias("row"), "stamp", "hash").select("row.*")
