"""Connected components of an undirected graph of long identifiers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is the smallest node reachable.

    In each round a node hands its larger neighbours, then its smaller ones, to the smallest that it knows, which needs
    a logarithmic number of rounds. Neighbourhoods are never gathered: each round is two minima by key, aggregated
    before they are shuffled, joined back with hot keys dealt into parts. Self-loops and repeated edges change nothing.
    """
    pairs = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = common.materialise(pairs, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        pairs = common.materialise(_small_star(_large_star(pairs, 2 * state[0])), "edges")
    else:
        raise RuntimeError("the components didn't settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _least(pairs: DataFrame, own: str) -> DataFrame:
    """(u, m, n): the smallest neighbour of each node that is smaller than itself, if any, and its number of rows in ``own``."""
    found = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.expr(own)).alias("n"))
    return common.materialise(found.where("n > 0"), "stars")


def _large_star(pairs: DataFrame, total: int) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "v > u").select("u", F.least("u", "m").alias("m"), "n")
    larger = both.where("v > u")
    return common.salted_join(larger, least, "u", "v", "inner", total=total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    pairs = common.materialise(pairs, "edges")
    least = _least(pairs, "true")
    moved = common.salted_join(pairs, least, "u", "v", "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
