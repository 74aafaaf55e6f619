"""Relevance scores of query terms.

A row's tokens are counted once: its length and the frequencies of the query's terms are written as a narrow table, from
which both the statistics and the scores are taken. No tokens are exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import scratch

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Known:
    """Number of documents, their mean length, and the documents with each term; each is one at least."""

    n: int
    length: float
    df: tuple[int, ...]


def frequency(words: Column, word: str) -> Column:
    return F.size(words) - F.size(F.array_remove(words, word))


def counted(docs: DataFrame, words: str, terms: list[str]) -> DataFrame:
    """``docs`` without their ``words``, and ``__length`` and ``__tf``, for rows with any of the terms."""
    counts = F.array(*[frequency(F.col(words), t) for t in terms])
    return docs.withColumn("__length", F.size(words)).withColumn("__tf", counts).drop(words)


def statistics(rows: DataFrame, terms: list[str]) -> Known:
    """One row, whose width is that of the query."""
    found = [F.count_if(F.col("__tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("__length").alias("length"), *found).first()
    return Known(row["n"], max(1.0, row["length"] or 0.0), tuple(max(1, row[f"df{i}"] or 0) for i in range(len(terms))))


def bm25(known: Known) -> Column:
    length = F.greatest(F.col("__length"), F.lit(1))
    parts = []
    for i, df in enumerate(known.df):
        tf = F.col("__tf")[i]
        parts.append(F.lit(_log(1 + (known.n - df + 0.5) / (df + 0.5))) * (K1 + 1) * tf / (tf + K1 * (1 - B + B * length / known.length)))
    return reduce(lambda a, b: a + b, parts)


def tfidf(known: Known) -> Column:
    """Frequency times log(N / df)."""
    return reduce(lambda a, b: a + b, [F.lit(_log(known.n / df)) * F.col("__tf")[i] for i, df in enumerate(known.df)])


def term_count(known: Known) -> Column:
    """How often the terms occur."""
    return reduce(lambda a, b: a + b, [F.col("__tf")[i].cast("double") for i in range(len(known.df))])


def _log(x: float) -> float:
    import math

    return math.log(x)


#: Scorers by name. A scorer makes a score over ``__tf`` and ``__length`` from what is known of the table; others may be added.
SCORERS: dict[str, Callable[[Known], Column]] = {"bm25": bm25, "tfidf": tfidf, "term_count": term_count}


def scored(docs: DataFrame, words: str, terms: list[str], scorer: str = "bm25", out: str = "score") -> DataFrame:
    """Rows with any of the terms and their score by the named scorer, without ``words``.

    Select the columns to be kept before: what is there is written.
    """
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer}")
    rows = counted(docs, words, terms)
    path = scratch(docs.sparkSession, "term-counts")
    rows.write.parquet(path)
    rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    score = SCORERS[scorer](statistics(rows, terms))
    return rows.where(F.exists("__tf", lambda n: n > 0)).withColumn(out, score).drop("__tf", "__length")


def with_bm25(docs: DataFrame, words: str, terms: list[str], out: str = "score") -> DataFrame:
    return scored(docs, words, terms, "bm25", out)


def with_tfidf(docs: DataFrame, words: str, terms: list[str], out: str = "score") -> DataFrame:
    return scored(docs, words, terms, "tfidf", out)
