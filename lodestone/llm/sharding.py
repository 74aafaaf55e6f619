"""K-d tree partitioning of documents into shards of nearly equal bytes.

Documents are points in a space of metadata dimensions. A node is split along its widest dimension at the weighted
median, the weight being the size in bytes, until leaves reach the target size. Medians are found by histograms: every
task adds the bytes of its points into a fixed number of bins for each node, and only those sums reach the driver; the
bin that holds the median is refined until it is one point or a negligible weight. Points of equal coordinates are told
apart by a hash, so a median never falls inside a large tie.

Copies of one text move together: a group of equal texts is one point, but for groups so large that they would spoil
the law, which are dealt into pieces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 8
LAW = "bytes"
#: Bits of a coordinate, of the hash that breaks ties, and of the bins of one histogram.
COORDINATE, TIE, BIN = 24, 36, 12
#: A bin with at most this share of a node's weight isn't refined further.
FINE = 0.0005
#: Copies in one piece of a group are at most this share of a shard's target.
PIECE = 1 / 48
#: Buckets of doc_ids by which places in a shard are numbered.
BUCKETS = 1024

DIMENSIONS = ("source", "size", "lang", "text")


@dataclass
class Node:
    low: int  # first and last shard below
    high: int
    dimension: str = ""
    cut: int = 0  # points with a key below the cut go left
    children: list["Node"] = field(default_factory=list)


def _coordinate(name: str) -> Column:
    """A metadata value as an integer of COORDINATE bits; null is zero."""
    top = float((1 << COORDINATE) - 1)
    if name == "size":
        return F.floor(F.least(F.log2(F.col("bytes").cast("double")) / 40.0, F.lit(1.0)) * top).cast("long")
    column = F.col("digest") if name == "text" else F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))
    return F.shiftrightunsigned(column, 64 - COORDINATE) if name == "text" else F.shiftright(column, 32 - COORDINATE)


def _with_groups(docs: DataFrame, target: float) -> DataFrame:
    """Add ``unit``, the hash of the point that a row belongs to, and make its metadata those of the group's first row."""
    groups = docs.groupBy("digest", "bytes").agg(
        F.min("doc_id").alias("first"), F.min_by(F.struct("source", "lang"), F.col("doc_id")).alias("meta"), F.count(F.lit(1)).alias("n")
    )
    copies = common.materialise(groups.where("n > 1"), "copies")
    size = F.col("n") * F.col("bytes")
    pieces = F.ceil(size / F.lit(max(1.0, target * PIECE))).cast("long")
    copies = copies.select("digest", "bytes", "meta", F.when(pieces > 1, F.least(pieces, F.col("n"))).otherwise(1).alias("pieces"))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).otherwise(0)
    joined = docs.join(copies, ["digest", "bytes"], "left")
    return joined.select(
        "doc_id",
        "bytes",
        "crc",
        "digest",
        F.coalesce(F.col("meta.source"), F.when(F.col("meta").isNull(), F.col("source"))).alias("source"),
        F.coalesce(F.col("meta.lang"), F.when(F.col("meta").isNull(), F.col("lang"))).alias("lang"),
        F.xxhash64("digest", F.when(F.col("meta").isNotNull(), piece).otherwise(F.lit(-1))).alias("unit"),
    )


def _keys() -> dict[str, Column]:
    """For each dimension a long that orders points by coordinate, then by hash."""
    tie = F.shiftrightunsigned("unit", 64 - TIE)
    return {name: F.shiftleft(_coordinate(name), TIE).bitwiseOR(tie) for name in DIMENSIONS}


def _leaf(node: Node) -> Column:
    if not node.children:
        return F.lit(node.low)
    return F.when(F.col(f"k_{node.dimension}") < node.cut, _leaf(node.children[0])).otherwise(_leaf(node.children[1]))


def _cuts(points: DataFrame, nodes: list[Node]) -> None:
    """Choose the widest dimension of each node and find its weighted median."""
    ranges = [f(f"k_{d}").alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    spans = {r["node"]: r for r in points.groupBy("node").agg(F.sum("bytes").alias("weight"), *ranges).collect()}
    whole = {d: max(1, max(r[f"high_{d}"] for r in spans.values()) - min(r[f"low_{d}"] for r in spans.values())) for d in DIMENSIONS} if spans else {}
    state = {}
    for i, node in enumerate(nodes):
        if i not in spans:
            node.dimension, node.cut = DIMENSIONS[0], 0
            continue
        r = spans[i]
        node.dimension = max(DIMENSIONS, key=lambda d: (r[f"high_{d}"] - r[f"low_{d}"]) / whole[d])
        left = (node.high - node.low + 1) // 2 / (node.high - node.low + 1)
        state[i] = {"from": 0, "shift": COORDINATE + TIE - BIN, "before": 0, "weight": r["weight"], "want": r["weight"] * left}
    while state:
        # one histogram for each open node: (node, bin) -> bytes, (1 << BIN) bins at most
        key = F.lit(None).cast("long")
        for i in state:
            key = F.when(F.col("node") == i, F.col(f"k_{nodes[i].dimension}")).otherwise(key)
        start, shift = F.lit(None).cast("long"), F.lit(None).cast("int")
        for i, s in state.items():
            start = F.when(F.col("node") == i, F.lit(s["from"])).otherwise(start)
            shift = F.when(F.col("node") == i, F.lit(s["shift"])).otherwise(shift)
        bins = points.select("node", "bytes", (key - start).alias("at"), shift.alias("shift")).where("at >= 0").select("node", "bytes", F.expr("shiftright(at, shift)").alias("bin"))
        rows = bins.where(F.col("bin") < 1 << BIN).groupBy("node", "bin").agg(F.sum("bytes").alias("weight")).collect()
        by_node: dict[int, list] = {}
        for r in rows:
            by_node.setdefault(r["node"], []).append((r["bin"], r["weight"]))
        for i in list(state):
            s = state[i]
            run = s["before"]
            for number, weight in sorted(by_node[i]):
                if run + weight >= s["want"]:
                    break
                run += weight
            edge = s["from"] + (number << s["shift"])
            if s["shift"] == 0 or weight <= FINE * s["weight"]:
                nearer = s["want"] - run > run + weight - s["want"]
                nodes[i].cut = edge + ((1 << s["shift"]) if nearer else 0)
                del state[i]
            else:
                s["from"], s["before"], s["shift"] = edge, run, max(0, s["shift"] - BIN)


def tree_of(points: DataFrame, shards: int) -> Node:
    root = Node(0, shards - 1)
    open_nodes = [root] if shards > 1 else []
    while open_nodes:
        place = F.lit(None).cast("int")
        for i, node in enumerate(open_nodes):
            place = F.when(F.col("leaf") == node.low, F.lit(i)).otherwise(place)
        _cuts(points.withColumn("leaf", _leaf(root)).withColumn("node", place).where("node is not null"), open_nodes)
        for node in open_nodes:
            middle = node.low + (node.high - node.low + 1) // 2
            node.children = [Node(node.low, middle - 1), Node(middle, node.high)]
        open_nodes = [c for node in open_nodes for c in node.children if c.high > c.low]
    return root


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    ``docs`` has doc_id, text, source and lang; null source and lang are a value of their own, a null text is empty, and
    other columns are ignored. size is the UTF-8 bytes of the text plus one. The law is ``bytes``: the tree has
    ``shards`` leaves whose target is the same share of all bytes. slot numbers the rows of a shard from 0 in the order of
    doc_id buckets. Repeated rows are copies like any other. An empty table gives no rows.
    """
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.col("lang").cast("string"),
        (F.octet_length(data) + 1).cast("long").alias("bytes"),
        F.crc32(data).alias("crc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"),
    )
    rows = common.materialise(rows, "shard-rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    units = common.materialise(_with_groups(rows, total / shards), "shard-units").withColumns({f"k_{n}": k for n, k in _keys().items()})
    points = common.materialise(units.select("bytes", *[f"k_{d}" for d in DIMENSIONS]), "shard-points")
    placed = units.select("doc_id", "bytes", "crc", _leaf(tree_of(points, shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    placed = common.materialise(placed, "placed")
    # at most shards * BUCKETS rows
    before = F.expr("sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding)")
    offsets = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = placed.withColumn("at", F.expr("row_number() over (partition by shard, bucket order by doc_id, crc)"))
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id",
        F.col("bytes").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("before") + F.col("at") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
