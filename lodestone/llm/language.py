"""Language identification with string kernels.

A text's features are which of its byte n-grams of 1 to ``SPECTRUM`` bytes occur, hashed to ``BUCKETS`` buckets; the
kernel of two texts is the number of buckets both have over the geometric mean of how many each has. A Nyström map over
a few landmark texts turns it into features for one-versus-rest kernel ridge regression. The kernel is linear in the
presence vectors, so landmarks and ridge weights fold into one matrix, and a batch of texts is scored by one product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPECTRUM = 4
BUCKETS = 1 << 15
#: The sample that the classifier is fitted on: so many texts of each language, fewer if all languages together would
#: exceed TEXTS, and so many languages at most, so that the model has a bound.
SAMPLE = 400
TEXTS = 4096
LANGUAGES = 1024
#: Landmarks of all languages together.
LANDMARKS = 192
RIDGE = 1e-2
#: One document in so many is held out.
FOLDS = 5
UNKNOWN = "und"
#: Bytes of a text that are hashed at a time.
SLICE = 1 << 20
ROWS = 128

_HAS_LETTER = regex.compile(r"\p{L}").search


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether the CRC-32 of the identifier as text is a multiple of ``folds``; false without identifier."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def presence(text: str, out: np.ndarray) -> None:
    """Set the bucket of each n-gram of ``text`` in ``out`` to one."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    for start in range(0, len(data), SLICE):
        part = data[start : start + SLICE + SPECTRUM - 1].astype(np.uint32)
        grams = np.zeros(len(part), np.uint32)
        for n in range(SPECTRUM):
            if n >= len(part):
                break
            grams = grams[: len(part) - n] * np.uint32(257) + part[n:] + np.uint32(1)
            out[(grams * np.uint32(2654435761)) >> np.uint32(32 - 15)] = 1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for start in range(0, len(texts), ROWS):
            own = [i for i in range(start, min(start + ROWS, len(texts))) if texts[i] and _HAS_LETTER(texts[i])]
            if not own:
                continue
            found = np.zeros((len(own), BUCKETS), np.uint8)
            for row, i in enumerate(own):
                presence(texts[i], found[row])
            sizes = found.sum(axis=1, dtype=np.int64)
            values = found.astype(np.float32) @ self.weights / np.sqrt(sizes)[:, None] + self.bias
            best = values.argmax(axis=1)
            for row, i in enumerate(own):
                names[i] = self.languages[best[row]]
                scores[i] = float(np.clip((values[row, best[row]] + 1) / 2, 0, 1))
        return names, scores


def _sampled(docs: DataFrame, each: int) -> DataFrame:
    """(doc_id, lang) of the documents to fit on: for each language those of the smallest hashes of their doc_id."""
    labelled = docs.where(~held_out(F.col("doc_id"))).where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang")
    # first within parts of a language, so that no task gets all rows of a frequent one
    for keys in ("lang, part", "lang"):
        ranked = labelled if keys == "lang" else labelled.withColumn("part", common.salt_of("doc_id", 16))
        labelled = ranked.withColumn("at", F.expr(f"row_number() over (partition by {keys} order by xxhash64(doc_id), doc_id)")).where(F.col("at") <= each).drop("at")
    return labelled.select("doc_id", "lang")


def fit(docs: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled ``docs`` (doc_id, text, lang) outside the held-out fold.

    The driver gets BUCKETS bits for each sampled text, whatever its length. Of more than LANGUAGES languages the most
    frequent are learned. Without labelled texts the model knows no language.
    """
    counted = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null").groupBy("lang").count()
    names = [r["lang"] for r in counted.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    if not names:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    sample = _sampled(docs.where(F.col("lang").isin(names)), min(SAMPLE, TEXTS // len(names))).dropDuplicates(["doc_id"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(2).to_pylist():
                own = np.zeros(BUCKETS, np.uint8)
                presence(text, own)
                bits.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    common.short_batches(docs.sparkSession)
    # at most TEXTS identifiers
    chosen = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = chosen.select("doc_id", "lang", "text").mapInArrow(featured, "doc_id long, lang string, bits binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    return solved([r["lang"] for r in rows], [r["bits"] for r in rows])


def _unpacked(bits: list[bytes]) -> np.ndarray:
    """Presence vectors of unit length."""
    found = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), BUCKETS // 8), axis=1).astype(np.float32)
    return found / np.sqrt(np.maximum(found.sum(axis=1), 1))[:, None]


def solved(labels: list[str], bits: list[bytes]) -> Model:
    """Kernel ridge regression over Nyström features of packed presence vectors."""
    languages = tuple(sorted(set(labels)))
    place = {x: i for i, x in enumerate(languages)}
    seen: dict[str, int] = {}
    marks = []
    for i, label in enumerate(labels):
        seen[label] = seen.get(label, 0) + 1
        if seen[label] <= max(1, LANDMARKS // len(languages)):
            marks.append(i)
    landmarks = _unpacked([bits[i] for i in marks])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    root = vectors @ np.diag(np.where(values > 1e-6 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)) @ vectors.T
    kernel = np.concatenate([_unpacked(bits[at : at + 256]) @ landmarks.T for at in range(0, len(bits), 256)])
    features = kernel.astype(np.float64) @ root
    target = -np.ones((len(labels), len(languages)))
    target[np.arange(len(labels)), [place[x] for x in labels]] = 1
    # languages weigh alike however many texts each has
    weight = np.array([1 / labels.count(x) for x in languages])[[place[x] for x in labels]]
    weight /= weight.mean()
    centre = np.average(features, axis=0, weights=weight)
    mean = np.average(target, axis=0, weights=weight)
    own = features - centre
    ridge = np.linalg.solve(own.T @ (own * weight[:, None]) + RIDGE * len(labels) / 100 * np.eye(own.shape[1]), own.T @ ((target - mean) * weight[:, None]))
    return Model(languages, landmarks.T @ (root @ ridge).astype(np.float32), mean - centre @ ridge)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang); fits on ``docs`` first.

    A null text or one without a letter is ``und`` with score 0, as is any text if no language was learned. Texts are
    whole; other columns are ignored, and lang is used for fitting only. Repeated rows give repeated predictions; of rows
    that repeat a doc_id with other texts one is fitted on. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                names, scores = sent.value.predict(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def with_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, lang, any others) whose language can be told; a null lang becomes the predicted one.

    Null texts and texts without a letter are rejected, and nothing else. If no language was learned, lang stays as it
    is. Texts are whole; rows that repeat are judged each; columns may have any names. An empty table stays empty.
    """
    common.short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = [f"c{i}" for i in range(len(docs.columns))]
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = batch.column(at).to_pylist()
                found, _ = sent.value.predict(texts)
                told = pa.array([x if x != UNKNOWN else None for x in found], pa.string())
                batch = batch.set_column(lang, batch.schema.field(lang), pc.coalesce(batch.column(lang), told))
                yield batch.filter(pa.array([bool(x and _HAS_LETTER(x)) for x in texts], pa.bool_()))

    kept = docs.toDF(*names).mapInArrow(keep, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True)))
    return kept.toDF(*docs.columns)
