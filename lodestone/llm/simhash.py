"""Near-duplicate documents by SimHash fingerprints, searched with BK-trees.

Distinct fingerprints are dealt into shards by the pigeonhole principle: of ``BLOCKS`` blocks of bits, two fingerprints
within ``RADIUS`` bits agree on at least ``BLOCKS - RADIUS``, so each goes to one shard for every choice of that many
blocks and any linked pair meets. A shard's BK-tree holds its fingerprints with children keyed by their Hamming
distance to the parent; a search follows only the edges within the radius. Trees reach the tasks through the shuffle,
not the driver: broadcasting them would gather the fingerprints of all documents there. A shard over ``CHUNK``
fingerprints is searched in pairs of its chunks. A shard gives a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, components

WORDS = 3
RADIUS = 3
SEED = 42
#: Widths of the blocks of bits; three of the six agree for any linked pair, so a shard is one value of 31 to 33 bits.
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one shard that one task takes; a larger shard is dealt out as pairs of chunks.
CHUNK = 4096
#: Shards with at least this many fingerprints are searched with arrays instead of one by one.
ARRAYS = 64
#: Hot shards whose list may be broadcast.
BROADCAST_ROWS = 20_000
_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def shingle_hashes(text: str | None) -> list[int]:
    words = text.encode().lower().split() if text else []  # bytes: lowers A-Z and splits at ASCII white space only
    if len(words) < WORDS:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    grams = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    return [xxhash.xxh64_intdigest(gram, SEED) for gram in grams]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero."""
    if not hashes:
        return 0
    counts = np.zeros((8, 8), np.int64)
    held = np.array(hashes, np.uint64)
    for at in range(0, len(held), 255):  # eight counters of a byte each are added at a time
        lanes = ((held[at : at + 255] >> _SHIFTS) & _LANES).sum(axis=1)
        counts += lanes.view(np.uint8).reshape(8, 8)
    bits = counts.T.reshape(64) * 2 > len(held)  # [byte, shift] is bit 8 * byte + shift
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(shingle_hashes(x.as_py())) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    common.short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Fingerprints with each node's children keyed by the Hamming distance to it."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.table: np.ndarray | None = None
        for new in range(1, len(values)):
            node, value = 0, values[new]
            while True:
                distance = (values[node] ^ value).bit_count()
                node_children = self.children[node]
                if distance not in node_children:
                    node_children[distance] = new
                    break
                node = node_children[distance]

    def within(self, value: int, radius: int = RADIUS) -> Iterator[int]:
        """Nodes within the radius of ``value``."""
        stack = [0]
        while stack:
            node = stack.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                yield node
            stack += [child for edge, child in self.children[node].items() if abs(edge - distance) <= radius]

    def within_all(self, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in ``queries``, node) within the radius, for unsigned queries, level by level of the tree."""
        if self.table is None:
            self.table = np.full((len(self.values), 65 + 2 * radius), -1, np.int32)
            for node, own in enumerate(self.children):
                for edge, child in own.items():
                    self.table[node, edge + radius] = child
        values = np.array(self.values, np.uint64)
        for start in range(0, len(queries), 128):
            at = np.arange(start, min(start + 128, len(queries)))
            node = np.zeros(len(at), np.int32)
            while len(at):
                distance = np.bitwise_count(values[node] ^ queries[at]).astype(np.int64)
                near = distance <= radius
                if near.any():
                    yield at[near], node[near]
                following = [(at, self.table[node, distance + shift]) for shift in range(2 * radius + 1)]
                at = np.concatenate([a[c >= 0] for a, c in following])
                node = np.concatenate([c[c >= 0] for _, c in following])


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        a_root, b_root = self.root(a), self.root(b)
        if a_root != b_root:
            self.parent[max(a_root, b_root)] = min(a_root, b_root)
            self.links.append((a, b))


def spanning_links(values: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct ``values``, as pairs of places."""
    forest = _Forest(len(values))
    tree = BKTree(values)
    if len(values) < ARRAYS:
        for i, value in enumerate(values):
            for node in tree.within(value):
                if node < i:
                    forest.link(node, i)
        return forest.links
    held = np.array(values, np.uint64)
    # Balls around a few pivots join most of a dense group, so that only what lies outside its largest part is searched:
    # a link between two parts has an end outside the largest.
    apart = np.ones(len(values), bool)
    for _ in range(64):
        if not apart.any():
            break
        pivot = int(apart.argmax())
        ball = np.flatnonzero(np.bitwise_count(held ^ held[pivot]) <= RADIUS)
        for i in ball.tolist():
            forest.link(pivot, i)
        apart[ball] = False
    roots = np.array([forest.root(i) for i in range(len(values))])
    outside = np.flatnonzero(roots != np.bincount(roots).argmax())
    for at, node in tree.within_all(held[outside]):
        for a, b in zip(outside[at].tolist(), node.tolist(), strict=True):
            forest.link(a, b)
    return forest.links


def _shard_keys(fp: Column) -> Column:
    """One key for each choice of BLOCKS - RADIUS blocks, from the bits of those blocks."""
    starts = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    blocks = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in zip(starts, WIDTHS, strict=True)]
    keys = []
    for number, chosen in enumerate(combinations(range(len(WIDTHS)), len(WIDTHS) - RADIUS)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, WIDTHS[i]).bitwiseOR(blocks[i])
        keys.append(key)
    return F.array(*keys)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each shard from rows (key, i, j, fp, rep) in the order of (key, i, j)."""
    rest = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        same = np.ones(max(0, len(columns[0]) - 1), bool)
        for c in columns[:3]:
            same &= c[1:] == c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
        rest = [c[starts[-1] :] for c in columns]
        yield from _links(columns[3], columns[4], starts)
    if rest is not None:
        yield from _links(rest[3], rest[4], np.array([0, len(rest[0])]))


def _links(fps: np.ndarray, reps: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    several = np.flatnonzero(np.diff(starts) > 1)
    for s in several.tolist():
        own = slice(int(starts[s]), int(starts[s + 1]))
        rep = reps[own]
        for x, y in spanning_links(fps[own].view(np.uint64).tolist()):
            a.append(int(rep[x]))
            b.append(int(rep[y]))
    if a:
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever is within RADIUS bits, for ``distinct`` (fp, rep) with one row for each fp."""
    keyed = distinct.select("fp", "rep", F.explode(_shard_keys(F.col("fp"))).alias("key"))
    hot = common.materialise(keyed.groupBy("key").count().where(F.col("count") > CHUNK).select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "hot-shards")
    n_hot = hot.count()
    whole = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if n_hot:
        side = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        known = keyed.join(side, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("own"))
        paired = known.where("chunks is not null").withColumn("own", own).withColumn("other", F.explode(others))
        whole = known.where("chunks is null").select("fp", "rep", "key", F.lit(0).alias("i"), F.lit(0).alias("j")).unionByName(
            paired.select("fp", "rep", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        )
    whole = whole.select("key", "i", "j", "fp", "rep")
    dealt = common.spread(whole, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints of three-word shingles link at RADIUS or fewer differing bits. component_id is the smallest doc_id
    reachable. Null texts and texts without words have fingerprint zero and link like any other; one of fewer words than
    a shingle is one shingle. Repeated rows share a component; a row without doc_id gets the component of its
    fingerprint, null if no row with a doc_id has that one. An empty table gives no rows; other columns are ignored.
    """
    prints = common.materialise(fingerprints(docs), "fingerprints")
    distinct = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct-prints")
    found = components.connected_components(links(distinct.where("rep is not null").select("fp", "rep")))
    # a fingerprint of one document without links stands for itself, and needs no join
    groups = distinct.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("n > 1 or component is not null")
    groups = common.materialise(groups.select("fp", F.coalesce("component", "rep").alias("component"), "n"), "groups")
    return common.salted_join(prints, groups, "fp", "doc_id").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) with the smallest doc_id of their component, with all their columns.

    Of rows that repeat a doc_id in one component one stays if it is the smallest there; those in other components are
    judged by their own. A row without doc_id stays. Null and empty texts are linked with each other like any others
    that are near; an empty table stays empty.
    """
    marks = near_duplicates(docs).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "fingerprint", "component_id")
    marks = common.materialise(marks, "near-marks")
    if not common.ids_repeat(marks):
        return common.staying(docs, marks)
    # rows of one doc_id in one component count as one, by the smallest of their fingerprints
    first = marks.where("kept").groupBy("doc_id").agg(F.min("fingerprint").alias("first"))
    marks = marks.join(first, "doc_id", "left").select("doc_id", (F.col("kept") & (F.col("fingerprint") == F.col("first"))).alias("kept"), F.conv("fingerprint", 16, -10).cast("long").alias("key"))
    return common.staying(_with_fingerprint(docs), common.materialise(marks, "near-marks"), F.col("__fp")).drop("__fp")


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` and one more column ``__fp``."""
    names, at = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(shingle_hashes(x.as_py())) for x in batch.column(at)), np.uint64, batch.num_rows)
            yield batch.append_column("fp", pa.array(found.view(np.int64)))

    common.short_batches(docs.sparkSession)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    return docs.toDF(*names).mapInArrow(run, f"{schema}, fp long").toDF(*docs.columns, "__fp")
