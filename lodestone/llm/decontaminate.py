"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

A window is a run of ``WINDOW`` consecutive words of a benchmark item; a shorter item is one window. The distinct windows
are a written table in the shared folder, and a task builds the automaton from it, so nothing of the benchmark passes
through the driver. All windows go into one automaton, so a document is scanned once, unless their text is over
``PART_BYTES``: then they are dealt into parts, each with its automaton, and what the parts find in a text is merged.
Words are kept with their offsets, so what is found in the normalised text maps back to spans of the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: A document is contaminated if one in this many of its words is hit.
SHARE = 20
#: Bytes of windows in one automaton; a worker holds one automaton at a time, some fifty times as large.
PART_BYTES = 4 << 20
#: Texts that are scanned together.
ROWS = 256

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(PATTERN)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_TYPES = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.translate(_LOWER)) if text else []


def windows(benchmark: DataFrame) -> DataFrame:
    """(window, n, items, unnamed): each distinct window between single spaces, its words, and the items that have it.

    Items without words, and null ones, have no windows. Windows of items without an id are there with ``unnamed``.
    """
    words = F.regexp_extract_all(common.ascii_lower(F.coalesce("text", F.lit(""))), F.lit(PATTERN), 0)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    each = items.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    each = each.select("item", "n", F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("at"), F.col("n")), " "), F.lit(" ")).alias("window"))
    return each.groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull()).alias("unnamed"))


class Parts:
    """The windows of a benchmark, written in parts of about PART_BYTES."""

    def __init__(self, benchmark: DataFrame):
        found = common.materialise(windows(benchmark), "windows")
        size = found.agg(F.sum(F.octet_length("window"))).first()[0] or 0
        self.number, self.path = -(-size // PART_BYTES), common.scratch(benchmark.sparkSession, "window-parts")
        if self.number:
            part = F.pmod(F.xxhash64("window"), F.lit(self.number)).cast("int")
            found.withColumn("part", part).repartition(int(self.number), "part").write.partitionBy("part").parquet(self.path)

    def names(self) -> list[str]:
        return [f"{self.path}/part={k}" for k in range(self.number)]


@lru_cache(maxsize=1)
def automaton_at(path: str) -> ahocorasick.Automaton:
    """The automaton of one part, kept by a worker process from task to task until it meets another part.

    It may have no window, if the hashes of a few left a part empty.
    """
    store, folder = fs.FileSystem.from_uri(common.uri(path))
    built = ahocorasick.Automaton()
    if store.get_file_info(folder).type != fs.FileType.NotFound:
        for batch in pq.ParquetDataset(folder, filesystem=store, partitioning=None).read(["window", "n", "items", "unnamed"]).to_batches(4096):
            for window, n, items, unnamed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                built.add_word(window, (n, (*items, None) if unnamed else tuple(items)))
    if len(built):
        built.make_automaton()
    return built


def _found(automaton, words: list[str]) -> tuple[np.ndarray, set]:
    """(sorted places of the hit words, ids of items with a window) in a text's words."""
    hit, items = [], set()
    if words and len(automaton):
        for end, (n, ids) in automaton.iter(f" {' '.join(words)} "):
            hit.append((end, n))
            items.update(ids)
    return _places(words, hit), items


def _places(words: list[str], hit: list[tuple[int, int]]) -> np.ndarray:
    if not hit:
        return np.empty(0, np.int64)
    # the space after word k stands at ends[k]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    at, n = np.array(sorted(set(hit)), np.int64).T
    last = np.searchsorted(ends, at)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, last - n + 1, 1)
    np.add.at(change, last + 1, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)


def _spans(text: str, places: np.ndarray) -> list[dict]:
    """Character spans of ``text`` that hold runs of hit words."""
    if not len(places):
        return []
    offsets = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
    return [{"start": offsets[r[0]][0], "end": offsets[r[-1]][1]} for r in runs]


def _scanned(batches: Iterator[pa.RecordBatch], column: int, path: str | None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, [(text, words, places, items)]) for some rows at a time; ``path`` names the part."""
    automaton = automaton_at(path) if path else ()
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            found = []
            for value in batch.column(column):
                text = value.as_py()
                words = words_of(text)
                found.append((text, words, *_found(automaton, words)))
            yield batch, found


def _finished(ids: pa.Array, found: list) -> pa.RecordBatch:
    """Rows of RESULT from [(text, words, places, items)]."""
    ordered = [sorted((x for x in items if x is not None)) + [None] * (None in items) for *_, items in found]
    return pa.RecordBatch.from_arrays([
        ids,
        pa.array([len(words) for _, words, _, _ in found], pa.int64()),
        pa.array([len(places) for _, _, places, _ in found], pa.int64()),
        pa.array(ordered, pa.list_(pa.string())),
        pa.array([_spans(text, places) for text, _, places, _ in found], _TYPES.field("spans").type),
    ], schema=_TYPES)


def _hits(docs: DataFrame, parts: Parts) -> DataFrame:
    """(t, n_words, places, items) of the texts that any of several parts hits; ``t`` is the digest of the text.

    Each part scans all documents. Of equal texts one is merged, so a group of copies is never gathered.
    """

    def scan_of(path: str):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, found in _scanned(batches, 1, path):
                own = [(i, words, places, items) for i, (_, words, places, items) in enumerate(found) if len(places)]
                yield pa.RecordBatch.from_pydict({
                    "t": batch.column(0).take(pa.array([i for i, *_ in own], pa.int64())),
                    "n_words": pa.array([len(words) for _, words, _, _ in own], pa.int64()),
                    "places": pa.array([places.tolist() for _, _, places, _ in own], pa.list_(pa.int32())),
                    "items": pa.array([list(items) for *_, items in own], pa.list_(pa.string())),
                })

        return scan

    texts = docs.where("text is not null").select(_digest(), "text")
    each = [texts.mapInArrow(scan_of(name), "t binary, n_words long, places array<int>, items array<string>").dropDuplicates(["t"]) for name in parts.names()]
    merged = reduce(DataFrame.unionByName, each).groupBy("t").agg(
        F.max("n_words").alias("n_words"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("places", "items")]
    )
    return common.materialise(merged, "window-hits")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("t")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of ``docs`` (doc_id, text).

    ``items`` are the ids of items with a window in the text, sorted as strings; a null at the end stands for items
    without an id. ``spans`` are the hit runs as character offsets of the original text. Null and empty texts have no
    words, nor have null items; an empty benchmark hits nothing. Texts and benchmarks are of any length. Rows that repeat
    get a row each, items that repeat count once; other columns are ignored. An empty table gives no rows.
    """
    common.short_batches(docs.sparkSession)
    parts = Parts(benchmark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts.number > 1:
        found = docs.withColumn("t", _digest()).join(_hits(docs, parts), "t", "left").select("doc_id", "text", "places", "items")

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    ids, *columns = whole.slice(at, ROWS).columns
                    rows = zip(*(c.to_pylist() for c in columns), strict=True)
                    yield _finished(ids, [(text, words_of(text), np.array(sorted(places or []), np.int64), set(items or ())) for text, places, items in rows])

        return found.mapInArrow(finish, RESULT)
    path = next(iter(parts.names()), None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, 1, path):
            yield _finished(batch.column(0), found)

    return docs.mapInArrow(scan, RESULT)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The registered query's columns from ``overlaps``, for the same rows. Items without an id count as one, unnamed."""
    return overlaps(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, any others) that are not contaminated, with all their columns.

    A row goes by its text alone: null and empty texts stay, rows that repeat share their fate, columns may have any names.
    With one part it is decided in one pass over the rows. An empty table stays empty, an empty benchmark removes nothing.
    """
    common.short_batches(docs.sparkSession)
    parts = Parts(benchmark)
    names, at = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")
    # columns go by place, so that names may clash
    rows = docs.toDF(*names)
    if parts.number > 1:
        hits = _hits(docs.select("text"), parts)
        gone = hits.where(contaminated(F.size("places").cast("long"), F.col("n_words"))).select("t")
        kept = rows.withColumn("t", F.unhex(F.sha2(F.col(names[at]), 256))).join(gone, "t", "left_anti").select(names)
        return kept.toDF(*docs.columns)
    path = next(iter(parts.names()), None)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, at, path):
            clean = [not (len(places) and len(places) * SHARE >= len(words)) for _, words, places, _ in found]
            yield batch.filter(pa.array(clean, pa.bool_()))

    kept = rows.mapInArrow(keep, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True)))
    return kept.toDF(*docs.columns)
