"""Exact deduplication over a log-structured merge index of text digests.

Rows enter the index in batches. A batch is a memtable: its digests are reduced to one entry each (smallest identifier,
number of rows), sorted, and written as a run next to a filter, which is a bitmap over hashes of the run's digests.
Compaction merges the runs: an entry that the filters of all other runs rule out goes on as it is, and only the others
are grouped again by digest. Rows are looked up by digest, and each hit is verified byte by byte against the text that
stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: White space that counts as one space when texts are compared.
SPACES = r"[\x20\x09-\x0D]+"
#: Members of one group of copies that are verified by one part of the join.
PART = 256
#: Batches that a call flushes; rows are dealt to them by identifier.
RUNS = 4
#: Bits of a filter for each digest, the bits of one bitmap row, and the rows of a filter that is broadcast at most (64 MB).
FILTER_BITS, BITMAP, BROADCAST_ROWS = 16, 32768, 16384


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _smallest(rows: DataFrame, least: Column, size: Column) -> DataFrame:
    return rows.groupBy("digest").agg(F.min(least).alias("keep_id"), F.sum(size).cast("long").alias("group_size"))


def _filter(digests: DataFrame, rows: int) -> DataFrame:
    """(bucket, bits): a bitmap of ``rows`` rows over the hashes of ``digests`` (digest)."""
    place = F.pmod(F.xxhash64("digest"), F.lit(rows * BITMAP))
    return digests.select(F.floor(place / BITMAP).alias("bucket"), (place % BITMAP).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _maybe_in(df: DataFrame, bits: DataFrame, rows: int, out: str) -> DataFrame:
    """Add the flag ``out``: false if the filter ``bits`` of ``rows`` rows rules the row's digest out."""
    place = F.pmod(F.xxhash64("digest"), F.lit(rows * BITMAP))
    byte = F.conv(F.hex(F.substring("bits", (place % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("bucket", F.floor(place / BITMAP)).join(bits, "bucket", "left")
    return met.withColumn(out, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bits")


class MergeIndex:
    """Digest index at ``path``; ``flush`` adds runs, ``compact`` merges them, ``entries`` reads the newest level."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.runs: list[DataFrame] = []
        self.filters: list[tuple[DataFrame, int]] = []
        self.level: DataFrame | None = None

    def flush(self, batch: DataFrame) -> None:
        """Write the run of a batch (doc_id, digest) with its filter."""
        run = self._written(_smallest(batch, F.col("doc_id"), F.lit(1)), f"run-{len(self.runs)}")
        rows = -(-max(1, run.count()) * FILTER_BITS // BITMAP)
        self.runs.append(run)
        self.filters.append((self._saved(_filter(run, rows), f"filter-{len(self.filters)}"), rows))
        self.level = None

    def maybe_in(self, rows: DataFrame, number: int, out: str) -> DataFrame:
        """Add the flag ``out``: false if the filter of run ``number`` rules the row's digest out."""
        return _maybe_in(rows, *self.filters[number], out)

    def compact(self) -> DataFrame:
        """Merge every run: (digest, keep_id, group_size), sorted by digest within each file."""
        if not self.runs:
            raise ValueError("flush a batch before compacting")
        parts = []
        for number, run in enumerate(self.runs):
            others = [k for k in range(len(self.runs)) if k != number]
            for k in others:
                run = self.maybe_in(run, k, f"in_{k}")
            shared = reduce(lambda a, b: a | b, [F.col(f"in_{k}") for k in others], F.lit(False))
            parts.append(run.select("digest", "keep_id", "group_size", shared.alias("shared")))
        entries = self._saved(reduce(DataFrame.unionByName, parts), f"asked-{len(self.runs)}")
        merged = _smallest(entries.where("shared"), F.col("keep_id"), F.col("group_size"))
        self.level = self._written(entries.where("not shared").drop("shared").unionByName(merged), f"level-{len(self.runs)}")
        return self.level

    def entries(self) -> DataFrame:
        return self.compact() if self.level is None else self.level

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        return self._saved(df.sortWithinPartitions("digest"), name)

    def _saved(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Return (doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Texts are equal when identical after each run of white space becomes one space; null counts as empty, and texts of
    any length are whole. The smallest doc_id of a group stays. A doc_id may repeat: a row with an equal text is marked
    like its twin, one with another text belongs to that text's group. A row without doc_id never stands for a group; it
    is dropped if its text has a row that stays, else kept. An empty table gives no rows. Other columns of ``docs`` are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    index = MergeIndex(spark, common.scratch(spark, "merge-index"))
    rows = common.materialise(docs.select("doc_id", _digest().alias("digest")), "digests")
    for number in range(RUNS):
        index.flush(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(RUNS)) == number))
    copies = common.materialise(index.compact().where("group_size > 1"), "copies")

    found = common.salted_join(rows, copies.withColumn("n", F.col("group_size")), "digest", "doc_id")
    wrong = common.materialise(_unverified(docs, copies), "unverified")
    if not wrong.isEmpty():
        found = _regrouped(docs, found, wrong)
    keep_id = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(normalised(F.col("text")), 256))


def _unverified(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(digest) of the groups in ``copies`` (digest, keep_id, group_size) with a text unlike that of the row that stays.

    Every hit is compared with the text of its group by the bytes. Texts that a filter over the groups' digests rules out
    aren't shuffled; its size is bounded, and where that makes it coarse, more are. A member meets its group's text in the
    part that its doc_id selects, and the number of parts follows the size of the group, so a group of any size is
    verified by many tasks.
    """
    parts = F.ceil(F.col("group_size") / PART).cast("int")
    rows = min(BROADCAST_ROWS, -(-max(1, copies.count()) * FILTER_BITS // BITMAP))
    bits = common.materialise(_filter(copies, rows), "copies-filter")
    texts = _maybe_in(docs.select("doc_id", "text", _digest().alias("digest")), F.broadcast(bits), rows, "maybe").where("maybe")
    texts = texts.select("doc_id", "digest", normalised(F.col("text")).alias("norm"))
    sized = copies.select("digest", "keep_id", parts.alias("parts"), F.col("group_size").alias("n"))
    members = common.materialise(common.salted_join(texts, sized, "digest", "doc_id", "inner"), "hits")
    # rows that repeat the doc_id that stays are members like any other
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("kept_norm"), F.first("parts").alias("parts"))
    stays = stays.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = F.pmod(F.xxhash64("doc_id", "norm"), F.col("parts")).cast("int")
    return members.withColumn("part", own).join(stays, ["digest", "part"]).where("norm != kept_norm").select("digest").distinct()


def _regrouped(docs: DataFrame, found: DataFrame, wrong: DataFrame) -> DataFrame:
    """Regroup the rows of the digests in ``wrong``, which several texts share, by their whole text."""
    texts = docs.select("doc_id", _digest().alias("digest"), normalised(F.col("text")).alias("norm")).join(wrong, "digest")
    texts = common.materialise(texts, "collisions")
    own = texts.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = texts.join(own, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")
    return found.join(wrong, "digest", "left_anti").select(again.columns).unionByName(again)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) that ``exact_duplicates`` keeps, with all their columns.

    Of rows that repeat a doc_id with equal texts one stays if they are kept; those with other texts are judged by their
    own. A row without doc_id stays. Null and empty texts are one text; an empty table stays empty.
    """
    marks = exact_duplicates(docs).select("doc_id", "kept", F.unhex("text_sha256").alias("key"))
    return common.staying(docs, common.materialise(marks, "exact-marks"), _digest())
