"""Fuzzy deduplication of lines across documents, in DataFrame operations only.

Lines are normalised to lower-case words; those of fewer than ``MIN_WORDS`` words are left alone. A distinct line gets a
SimHash of its words, and lines within ``RADIUS`` bits whose edit similarity is at least ``SIMILARITY`` are linked. Of
each group that links connect, the first occurrence stays, by doc_id and then by place.

Candidates meet in pigeonhole blocks: fingerprints go by every pair of five blocks of bits, one pair of which any two
within the radius share. Inside a block a window over the fingerprints in order compares each with the first and with
the ``NEIGHBOURS`` before it, which is every pair of a small block without a join. In larger blocks, whatever is still
in different groups after that is compared in a join that gives only pairs within the radius, so no pair is lost and a
block of near copies, which the windows have joined already, doesn't give the square of its size.

A first pass compares fingerprints by their first lines, and the lines of a fingerprint with its first. A second one
compares every pair of lines of near or equal fingerprints that is still in different groups.
"""

from __future__ import annotations

import operator
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, components

MIN_WORDS = 5
RADIUS = 3
SIMILARITY = 0.8
WIDTHS = (12, 12, 12, 12, 12)
NEIGHBOURS = 8
#: The fingerprint has LANES * EACH bits; each counter of words takes LANES bits of a long, so up to CHUNK words fit.
#: PIECE words are counted at once where the text is read: twice what a counter of half the bits holds.
LANES, EACH, CHUNK, PIECE = 10, 6, 256, 62
#: A side of a join that is measured to be at most this large is broadcast.
BROADCAST_BYTES = 48 << 20
_MASK = sum(1 << LANES * i for i in range(EACH))
_ID = "decimal(38,0)"


def words_of(line: Column) -> Column:
    """Lower-case words of letters and digits. Matching words is faster than splitting, which compiles its pattern for each line."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normalised(line: Column) -> Column:
    return F.array_join(words_of(line), " ")


def _digest(norm: Column) -> Column:
    return F.xxhash64(norm)


def _bit_sums(hashes: str, at: Column) -> list[Column]:
    """Sums that count, in lanes of LANES bits, those of the PIECE hashes from ``at`` on that have each bit.

    A few words are counted in lanes of half the width first, so that one addition counts twice as many bits.
    """
    narrow = LANES // 2
    few, each = (1 << narrow) - 1, sum(1 << narrow * i for i in range(2 * EACH))
    sums = [F.lit(0).cast("long")] * LANES
    for start in range(0, PIECE, few):
        words = [F.coalesce(F.get(hashes, at + k), F.lit(0).cast("long")) for k in range(start, min(start + few, PIECE))]
        for j in range(narrow):
            lanes = reduce(operator.add, [F.shiftrightunsigned(word, j).bitwiseAND(F.lit(each)) for word in words])
            sums[j] = sums[j] + lanes.bitwiseAND(F.lit(_MASK * few))
            sums[j + narrow] = sums[j + narrow] + F.shiftrightunsigned(lanes, narrow).bitwiseAND(F.lit(_MASK * few))
    return [s.alias(f"s{j}") for j, s in enumerate(sums)]


def _fingerprint(n: Column) -> Column:
    """A bit is 1 if over half of the ``n`` words have it, for up to CHUNK words.

    The top bit of a lane of 2 * count + (half - 1 - n) tells whether 2 * count > n, so EACH bits are compared at once.
    """
    half = 1 << (LANES - 1)
    base = (F.lit(half - 1) - n) * F.lit(_MASK)
    fp = None
    for j in range(LANES):
        bits = F.shiftleft(F.shiftrightunsigned(F.col(f"s{j}") * 2 + base, LANES - 1).bitwiseAND(F.lit(_MASK)), j)
        fp = bits if fp is None else fp.bitwiseOR(bits)
    return fp


def _long_fingerprint(n: Column) -> Column:
    """The same from one sum for each bit, ``b0`` and on, for any number of words."""
    fp = F.lit(0).cast("long")
    for bit in range(LANES * EACH):
        fp = fp.bitwiseOR(F.when(F.col(f"b{bit}") * 2 > n, F.lit(1 << bit)).otherwise(F.lit(0)))
    return fp


def _occurrence() -> Column:
    """A number that orders occurrences by doc_id, then by place."""
    return F.col("doc_id").cast(_ID) * F.lit(1 << 32).cast(_ID) + F.col("line_no").cast(_ID)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, row, line_no, words) for every line; t stands for the text, row for the row of ``docs``."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("row"), "text")
    lines = rows.select("doc_id", "t", "row", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "t", "row", "line_no", words_of(F.col("line")).alias("words"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line_no, d1, d2, length, fp) of every line of at least MIN_WORDS words, for each row of ``docs``.

    ``t`` is a hash of the text that the line is in, ``d1`` and ``d2`` stand for the line itself. Each distinct word of
    a line, told by its hash, counts once: else the frequent words of a language, which all long lines share, would
    outvote the others. Words are counted by bit where the text is read, so no text is shuffled: a line of up to PIECE
    words has its fingerprint there, and only the counts of longer ones are added up in a shuffle.
    The outer forms of explode and the filter after the last one keep each line from being split several times: a
    filter on an array's size would be computed from the text anew.
    """
    norm = F.array_join("words", " ")
    out = ["doc_id", "t", "line_no", "d1", "d2", "length"]
    hashes = F.array_distinct(F.transform("words", lambda word: F.xxhash64(word)))
    lines = _lines(docs).select("doc_id", "t", "row", "line_no", F.size("words").alias("n_words"), _digest(norm).alias("d1"), F.xxhash64(F.lit(1), norm).alias("d2"), F.length(norm).alias("length"), hashes.alias("hashes"))
    pieces = F.when(F.col("n_words") >= MIN_WORDS, F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(PIECE)))
    each = lines.select(*out, "row", "hashes", F.size("hashes").alias("n"), F.explode_outer(pieces).alias("at")).where("at is not null")
    summed = each.select(*out, "row", "n", *_bit_sums("hashes", F.col("at")))
    # written, since lines of each length are read from it
    kept = [F.when(F.col("n") > PIECE, F.col(f"s{j}")).alias(f"s{j}") for j in range(LANES)]
    summed = common.materialise(summed.select(*out, "row", "n", F.when(F.col("n") <= PIECE, _fingerprint(F.col("n"))).alias("fp"), *kept), "lines")
    several = summed.where("fp is null")
    added = several.where(F.col("n") <= CHUNK).groupBy(*out, "row", "n").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(LANES)]).select(*out, _fingerprint(F.col("n")).alias("fp"))
    bits = [F.sum(F.shiftrightunsigned(f"s{bit % LANES}", bit // LANES * LANES).bitwiseAND(F.lit((1 << LANES) - 1).cast("long"))).alias(f"b{bit}") for bit in range(LANES * EACH)]
    long = several.where(F.col("n") > CHUNK).groupBy(*out, "row", "n").agg(*bits).select(*out, _long_fingerprint(F.col("n")).alias("fp"))
    return summed.where("fp is not null").select(*out, "fp").unionByName(common.materialise(added.unionByName(long), "longer-lines"))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _keys(fp: Column) -> Column:
    starts = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    blocks = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in zip(starts, WIDTHS, strict=True)]
    keys = []
    for number, (i, j) in enumerate(combinations(range(len(WIDTHS)), len(WIDTHS) - RADIUS)):
        keys.append(F.shiftleft(F.shiftleft(F.lit(number).cast("long"), WIDTHS[i]).bitwiseOR(blocks[i]), WIDTHS[j]).bitwiseOR(blocks[j]))
    return F.array(*keys)


def _neighbours(prints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) within the radius that a block's window compares, with its first and with others, and larger blocks."""
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    order = Window.partitionBy("key").orderBy("fp")
    # most blocks hold one fingerprint; only the others are looked at more closely
    shared = keyed.select("key", "fp", F.lag("fp").over(order).alias("last"), F.lead("fp").over(order).alias("next"))
    shared = shared.where("last is not null or next is not null").select("key", "fp")
    before = [F.lag("fp", i).over(order) for i in range(1, NEIGHBOURS + 1)]
    first = F.first("fp").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = shared.select("key", "fp", F.row_number().over(order).alias("at"), first.alias("first"), F.array_compact(F.array(*before)).alias("others")).where("at > 1")
    near = F.filter("others", lambda other: F.bit_count(other.bitwiseXOR(F.col("fp"))) <= RADIUS)
    met = common.materialise(met.select("key", "fp", "at", "first", near.alias("others")), "line-neighbours")
    firsts = met.where(_distance("fp", "first") <= RADIUS).select(F.col("fp").alias("a"), F.col("first").alias("b")).distinct()
    others = met.where(F.size("others") > 0).select(F.col("fp").alias("a"), F.explode("others").alias("b")).distinct()
    return firsts, others, met.where(F.col("at") == NEIGHBOURS + 2).select("key")


def _by_size(left: DataFrame, right: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """Join with ``right`` broadcast if its measured size allows, else by a shuffle. ``right`` is a written table."""
    arrays = [F.size(f.name) * 16 for f in right.schema if f.dataType.typeName() == "array"]
    width = sum(arrays, F.lit(40 + 16 * len(right.columns)))
    size = right.agg(F.sum(width)).first()[0] or 0
    return left.join(F.broadcast(right) if size <= BROADCAST_BYTES else right, key, how)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) of those ``pairs`` (a, b, a_d1, b_d1) of occurrences whose lines' edit similarity is at least SIMILARITY."""
    pairs = common.materialise(pairs, "line-pairs")
    ids = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("id"), F.col(f"{x}_d1").alias("d1")) for x in ("a", "b")])).alias("x")).select("x.*").distinct()
    doc_id = F.floor(F.col("id") / F.lit(1 << 32).cast(_ID)).cast("long")
    places = ids.select("id", "d1", doc_id.alias("doc_id")).withColumn("line_no", (F.col("id") - F.col("doc_id").cast(_ID) * F.lit(1 << 32).cast(_ID)).cast("int"))
    places = common.materialise(places.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "d1")).alias("wanted")), "line-places")
    found = _by_size(docs.where("text is not null"), places, "doc_id", "inner")
    lines = found.select("doc_id", F.explode("wanted").alias("w"), F.split("text", "\n", -1).alias("lines")).select("doc_id", "w.line_no", "w.d1", normalised(F.get("lines", F.col("w.line_no"))).alias("norm"))
    # rows may repeat, and with other texts: those that hold the line count, and one of them
    texts = lines.where(_digest(F.col("norm")) == F.col("d1")).groupBy(_occurrence().alias("id")).agg(F.min("norm").alias("norm"))
    texts = common.materialise(texts, "line-texts")
    met = pairs.select("a", "b").join(texts.withColumnsRenamed({"id": "a", "norm": "x"}), "a").join(texts.withColumnsRenamed({"id": "b", "norm": "y"}), "b")
    most, apart = _most_and_apart(F.length("x"), F.length("y"))
    # written before it is filtered: a filter would be pushed below and compute its inputs several times
    judged = met.select("a", "b", "x", "y", most.alias("most"), apart.alias("apart"))
    return common.materialise(_judged(judged).select("a", "b", "near"), "line-verified").where("near").select("a", "b")


def _most_and_apart(x: Column, y: Column) -> tuple[Column, Column]:
    """The largest edit distance of near lines of these lengths, and what the lengths alone make of it."""
    longest, shortest = F.greatest(x, y), F.least(x, y)
    return F.floor(longest * F.lit(1 - SIMILARITY) + F.lit(1e-9)).cast("int"), longest - shortest


def _judged(pairs: DataFrame) -> DataFrame:
    """Add ``near``: whether the edit distance of x and y is at most ``most``.

    Edits word by word bound the distance from above, which settles most pairs; for others what the lines have in
    common at both ends is cut off, which leaves the distance as it is, before it is bounded again, also by edits that
    shift words, or computed.
    """
    x, y = F.split("x", " "), F.split("y", " ")
    differ = F.zip_with(x, y, lambda a, b: F.when(a == b, 0).otherwise(F.greatest(F.length(a), F.length(b))))
    bound = F.when(F.size(x) == F.size(y), F.aggregate(differ, F.lit(0), lambda s, d: s + d))
    settled = F.when(F.col("apart") > F.col("most"), F.lit(False)).when(bound <= F.col("most"), F.lit(True))
    pairs = pairs.withColumn("settled", settled)
    pairs = pairs.withColumn("head", F.when(F.col("settled").isNull(), _common_head(F.col("x"), F.col("y"))))
    pairs = pairs.withColumns({c: F.reverse(F.substring(c, F.col("head") + 1, F.length(c))) for c in ("x", "y")})
    pairs = pairs.withColumn("tail", F.when(F.col("settled").isNull(), _common_head(F.col("x"), F.col("y"))))
    pairs = pairs.withColumns({c: F.substring(c, F.col("tail") + 1, F.length(c)) for c in ("x", "y")})
    # what is left of the longer line bounds the distance as well
    rest = F.greatest(F.length("x"), F.length("y")) <= F.col("most")
    pairs = pairs.withColumn("all", F.when(F.col("settled").isNull() & ~rest, F.array_distinct(F.concat(F.split("x", " "), F.split("y", " ")))))
    return pairs.withColumn("near", F.coalesce("settled", F.when(rest, True), F.when(_few_words(), True), F.expr("levenshtein(x, y, most) >= 0")))


def _few_words() -> Column:
    """Whether edits of whole words of x and y, which are in ``all``, already bound their distance by ``most``.

    Each word becomes a character of its own, so that the words of long lines are compared in a small part of the time.
    An edit of a word changes at most the longest word and a space. With over 255 words it isn't known.
    """
    x, y = (F.array_join(F.transform(F.split(c, " "), lambda word: F.char(F.array_position("all", word))), "") for c in ("x", "y"))
    longest = F.array_max(F.transform("all", lambda word: F.length(word))) + 1
    return F.when(F.size("all") < 256, F.levenshtein(x, y) * longest <= F.col("most"))


def _common_head(x: Column, y: Column) -> Column:
    """Length of a common beginning, the longest up to 65535 characters, by halving steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(15, -1, -1)])
    shorter = F.least(F.length(x), F.length(y))
    same = lambda at, n: (at + n <= shorter) & (F.substring(x, at + 1, n) == F.substring(y, at + 1, n))
    return F.aggregate(steps, F.lit(0), lambda at, n: F.when(same(at, n), at + n).otherwise(at))


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, t, line_no, d1, d2), and (d1, d2, kept) with the occurrence that stays, for groups of several."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = fingerprinted(docs)
    found = lines.groupBy("d1", "d2").agg(F.min(_occurrence()).alias("id"), F.min("fp").alias("fp"), F.min("length").alias("length"), F.count(F.lit(1)).alias("n"))
    distinct = common.materialise(found, "distinct-lines")
    prints = common.materialise(distinct.groupBy("fp").agg(F.min("id").alias("id"), F.min_by("d1", "id").alias("d1"), F.count(F.lit(1)).alias("n")), "line-prints")
    firsts, others, crowded = _neighbours(prints)
    id_of = prints.select("fp", "id", "d1")
    shared = common.materialise(prints.where("n > 1").select("fp", F.col("id").alias("first"), F.col("d1").alias("first_d1")), "shared-prints")

    def as_lines(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.withColumnRenamed(side, "fp").join(id_of, "fp").drop("fp").withColumnsRenamed({"id": side, "d1": f"{side}_d1"})
        return pairs.select("a", "b", "a_d1", "b_d1")

    # first the lines of one fingerprint are compared with its first
    same = _by_size(distinct, shared, "fp", "inner").where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"), F.col("d1").alias("a_d1"), F.col("first_d1").alias("b_d1"))
    links = _verified(docs, as_lines(firsts).unionByName(same))
    groups = components.connected_components(links)
    # whatever else may link is verified only where the groups are still apart
    labelled = distinct.join(groups.withColumnRenamed("node", "id"), "id", "left").select("fp", "id", "d1", "length", F.coalesce("component", "id").alias("part"))
    labelled = common.materialise(labelled, "line-parts")
    close = others.unionByName(_with_later_lines(firsts, shared))
    crowded = common.materialise(crowded.distinct(), "crowded-blocks")
    if not crowded.isEmpty():
        close = close.unionByName(_apart(labelled, crowded)).distinct()
    rest = common.materialise(_across(labelled, close).unionByName(_within(labelled, shared)).distinct(), "line-pairs")
    if not rest.isEmpty():
        # the groups are nodes now, so that only what is new is gone over again
        more = _verified(docs, rest)
        label = groups.withColumnsRenamed({"component": "part"})
        for side in ("a", "b"):
            more = more.join(label.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("part", side)).drop("part")
        over = components.connected_components(more).withColumnsRenamed({"component": "top"})
        joined = groups.join(over.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        alone = over.join(groups.select("node"), "node", "left_anti").select("node", F.col("top").alias("component"))
        groups = joined.unionByName(alone)
    groups = groups.withColumnRenamed("node", "id")
    kept = distinct.join(groups, "id", "left").where("n > 1 or component is not null").select("d1", "d2", F.coalesce("component", "id").alias("kept"))
    return lines.select("doc_id", "t", "line_no", "d1", "d2"), common.materialise(kept, "kept-lines")


def _with_later_lines(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """Those pairs (a, b) of fingerprints of which one has several lines, so that its first doesn't settle them."""
    a, b = (pairs.join(shared.select(F.col("fp").alias(side)), side, "left_semi").select("a", "b") for side in ("a", "b"))
    return a.unionByName(b)


def _open(x: str, y: str) -> Column:
    """Whether lines with these prefixes are in different groups, and their lengths let them be near."""
    most, apart = _most_and_apart(F.col(f"{x}_length"), F.col(f"{y}_length"))
    return (F.col(f"{x}_part") != F.col(f"{y}_part")) & (apart <= most)


_SIDE = ("id", "d1", "length", "part")
_PAIR = ["a_id as a", "b_id as b", "a_d1", "b_d1"]


def _across(labelled: DataFrame, close: DataFrame) -> DataFrame:
    """Pairs of lines in different groups, one of each of two fingerprints ``close`` (a, b)."""
    for side in ("a", "b"):
        close = close.join(labelled.select(F.col("fp").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in _SIDE]), side)
    return close.where(_open("a", "b")).selectExpr(*_PAIR)


def _within(labelled: DataFrame, shared: DataFrame) -> DataFrame:
    """Pairs of lines of one fingerprint in different groups; the first line has been compared with all."""
    lines = _by_size(labelled, shared.select("fp", "first"), "fp", "inner").where("id != first")
    mixed = lines.groupBy("fp").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("fp")
    lines = common.materialise(lines.join(mixed, "fp").select("fp", *_SIDE), "later-lines")
    a, b = (lines.select("fp", *[F.col(c).alias(f"{side}_{c}") for c in _SIDE]) for side in ("a", "b"))
    return a.join(b, "fp").where((F.col("a_id") < F.col("b_id")) & _open("a", "b")).selectExpr(*_PAIR)


def _apart(labelled: DataFrame, crowded: DataFrame) -> DataFrame:
    """Pairs of fingerprints within the radius that share a larger block and aren't in one group yet with all lines."""
    keyed = labelled.select("fp", "part").distinct().select("fp", "part", F.explode(_keys(F.col("fp"))).alias("key"))
    keyed = common.materialise(_by_size(keyed, crowded, "key", "left_semi"), "crowded")
    mixed = keyed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key")
    keyed = common.materialise(keyed.join(mixed, "key"), "mixed")
    other = keyed.withColumnsRenamed({"fp": "b", "part": "other"})
    close = (F.col("a") < F.col("b")) & (F.col("part") != F.col("other")) & (_distance("a", "b") <= RADIUS)
    own = keyed.withColumnRenamed("fp", "a")
    return own.join(other, (own["key"] == other["key"]) & close).select("a", "b").distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, dropped) for every row of ``docs`` (doc_id, text): the lines that stay, joined again.

    ``dropped`` has the places of the lines that went, from 0. A null text stays null and has no lines; an empty text is
    one empty line; lines of any length are whole. Lines of fewer than MIN_WORDS words stay. A row without doc_id stays as
    it is. Rows that repeat a doc_id with one text lose the same lines; with other texts each loses its own, and lines at
    one place of them count as one occurrence. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines, kept = line_groups(docs)
    # both sides are written tables, so a frequent line is split by the adaptive skew join
    gone = lines.join(kept, ["d1", "d2"]).where(_occurrence() != F.col("kept"))
    gone = common.materialise(gone.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line_no")).alias("dropped")), "dropped-lines")
    held = _by_size(docs.withColumn("t", F.xxhash64("text")), gone, ["doc_id", "t"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    parts = F.split("text", "\n", -1)
    rest = F.filter(parts, lambda line, at: ~F.array_contains("dropped", at))
    text = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(rest, "\n"))
    return held.select("doc_id", text.alias("text"), F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), "dropped")


def report(docs: DataFrame) -> DataFrame:
    """The registered query's columns: counts, the dropped places, and the digest of the text that stays."""
    return deduplicated(docs).select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
