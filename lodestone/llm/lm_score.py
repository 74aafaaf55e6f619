"""Language-model scores of whole texts: a log-bilinear model over words, trained with noise-contrastive estimation.

Tokens are the words of a text and one end. The most frequent words are units of their own, as is the end; all other
words share a unit with those of the same last bytes. The log-bilinear model predicts a unit from the units of the
``CONTEXT`` tokens before it: with context vectors R, position matrices C, target vectors Q and biases b,

    h = sum over j of R[u_j] C_j,    P(u | h) = softmax(h A' + a)[group of u] * softmax(h Q' + b)[u among its group],

where units are put into groups by frequency, so that one token costs two small softmaxes and not one over all units. A
word of a shared unit has its smoothed relative frequency there, so all words' probabilities sum to one.

Training goes over all training tokens. A task gets a model, follows the gradients of noise-contrastive estimation over
its part of the documents, and returns its parameters; those of all tasks are averaged, weighted by their tokens, and
the next round begins with the average. What the driver holds is the model, whose size doesn't follow the corpus. Word
counts are unbounded: frequent words are sent to the tasks as a table of fixed size, the rest meets its counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language import held_out

FOLDS = 10
#: Words that are units of their own, and units of other words by their last SUFFIX bytes. Unit 0 is the end's.
WORDS, SUFFIXES, SUFFIX = 8191, 512, 3
UNITS = 1 + WORDS + SUFFIXES
#: Units of one group; groups follow each other by falling frequency.
GROUP = 96
#: Words whose counts every task gets, at most.
FREQUENT = 131_072
#: Distinct tokens that a task counts before it hands them on.
HELD = 300_000
SMOOTH = 0.1
#: Model and training: tokens of context, vector length, most tokens of a gradient step, noise units, learning rate.
CONTEXT, DIMENSION, BATCH, NOISE, RATE = 3, 24, 32768, 16, 0.15
#: Rounds of training, each over its own part of the documents; fewer tokens than LEAST_TOKENS are seen several times.
ROUNDS, LEAST_TOKENS, MOST_PASSES = 4, 2_000_000, 12
#: Steps are of SMALL_BATCH to BATCH tokens, so that a task makes some STEPS of them in a round.
SMALL_BATCH, STEPS = 4096, 200
#: Rows of parameters that are averaged together.
BLOCK = 256
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, and the end."""
    words = text.encode().lower().split() if text else []
    words.append(END)
    return words


def suffix_unit(word: bytes) -> int:
    return 1 + WORDS + zlib.crc32(word[-SUFFIX:]) % SUFFIXES


@dataclass
class LogBilinear:
    """Parameters, with the accumulated squares of their gradients; ``groups`` lists the first unit place of each group.

    ``order`` puts units in the order of their groups: place k holds unit order[k], and groups are runs of places.
    """

    order: np.ndarray
    contexts: np.ndarray  # R, by unit
    matrices: np.ndarray  # C, by position
    group_targets: np.ndarray  # A
    group_bias: np.ndarray  # a
    targets: np.ndarray  # Q, by place
    bias: np.ndarray  # b, by place

    NAMES = ("contexts", "matrices", "group_targets", "group_bias", "targets", "bias")

    @classmethod
    def started(cls, unigram: np.ndarray, seed: int = 11) -> LogBilinear:
        """A model that ignores the context and gives each unit its share in ``unigram`` (counts by unit)."""
        rng, n = np.random.default_rng(seed), len(unigram)
        order = np.argsort(-unigram, kind="stable")
        share = unigram[order] + 0.5
        share = share / share.sum()
        starts = np.arange(0, n, GROUP)
        mass = np.add.reduceat(share, starts)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        matrices = np.stack([np.eye(DIMENSION, dtype=np.float32) / (1 + j) for j in range(CONTEXT)])
        within = np.log(share / np.repeat(mass, np.diff(np.append(starts, n))))
        return cls(order, small(n, DIMENSION), matrices, small(len(starts), DIMENSION), np.log(mass).astype(np.float32), small(n, DIMENSION), within.astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, name) for name in self.NAMES]

    def places(self) -> np.ndarray:
        """The place of each unit."""
        found = np.empty(len(self.order), np.int64)
        found[self.order] = np.arange(len(self.order))
        return found

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """h for rows of CONTEXT units, the nearest first."""
        return sum((self.contexts @ self.matrices[j])[before[:, j]] for j in range(CONTEXT))

    def log10_probabilities(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each unit of ``after`` in its context, by one product for each group."""
        moved = [self.contexts @ self.matrices[j] for j in range(CONTEXT)]
        place_of = self.places()
        out = np.empty(len(after), np.float64)
        for start in range(0, len(after), 1 << 15):
            place = place_of[after[start : start + (1 << 15)]]
            order = np.argsort(place.astype(np.uint16), kind="stable")
            place, held = place[order], before[start : start + (1 << 15)][order]
            h = moved[0][held[:, 0]]
            for j in range(1, CONTEXT):
                h += moved[j][held[:, j]]
            found = _log_softmax(h @ self.group_targets.T + self.group_bias, place // GROUP)
            for a, b, g in _runs(place):
                own = slice(g * GROUP, (g + 1) * GROUP)
                found[a:b] += _log_softmax(h[a:b] @ self.targets[own].T + self.bias[own], place[a:b] - g * GROUP)
            out[start + order] = found
        return out / np.log(10)


def _log_softmax(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """log softmax of one column in each row of ``values``, which is used up."""
    if values.max() > 60 or values.min() < -60:
        values -= values.max(axis=1, keepdims=True)
    own = values[np.arange(len(values)), chosen].astype(np.float64)
    np.exp(values, out=values)
    return own - np.log(values @ np.ones(values.shape[1], values.dtype), dtype=np.float64)


def _runs(place: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(from, to, group) for each group that occurs in sorted places."""
    ends = np.searchsorted(place, np.arange(GROUP, place[-1] + GROUP + 1, GROUP)) if len(place) else ()
    last = 0
    for g, end in enumerate(ends):
        if end > last:
            yield last, int(end), g
        last = int(end)


class Trainer:
    """Follows noise-contrastive gradients from a model on; the steps are scaled by the squares of past gradients.

    A group's noise is drawn from the groups by their frequency, a unit's noise from the units of its group. The tokens
    of a step share their noise.
    """

    def __init__(self, model: LogBilinear, unigram: np.ndarray, squares: list[np.ndarray] | None = None, seed: int = 5):
        self.model, self.place_of = model, model.places()
        self.squares = squares or [np.full(x.shape, 1e-4, np.float32) for x in model.parts()]
        self.rng, n = np.random.default_rng(seed), len(model.order)
        share = unigram[model.order] + 0.5
        starts = np.arange(0, n, GROUP)
        mass = np.add.reduceat(share, starts)
        self.group_noise = mass / mass.sum()
        self.noise = [share[a : a + GROUP] / share[a : a + GROUP].sum() for a in starts]
        self.shift = np.log(NOISE * np.concatenate(self.noise))
        self.tokens = 0

    def step(self, before: np.ndarray, after: np.ndarray) -> None:
        m, n = self.model, len(after)
        place = self.place_of[after]
        order = np.argsort(place.astype(np.uint16), kind="stable")  # so that the tokens of a group, and those of a unit, stand together
        place, before = place[order], before[order]
        h, group = m.predicted(before), place // GROUP
        back, g_targets, g_bias = self._contrast(h, group, m.group_targets, m.group_bias, np.log(NOISE * self.group_noise))
        self._against(h, back, m.group_targets, m.group_bias, self.group_noise, g_targets, g_bias)
        more, u_targets, u_bias = self._contrast(h, place, m.targets, m.bias, self.shift)
        back += more
        for a, b, g in _runs(place):
            own = slice(g * GROUP, (g + 1) * GROUP)
            self._against(h[a:b], back[a:b], m.targets[own], m.bias[own], self.noise[g], u_targets[own], u_bias[own])
        r_gradient, c_gradient = np.zeros_like(m.contexts), np.empty_like(m.matrices)
        for j in range(CONTEXT):
            summed = _summed(before[:, j], back, len(m.contexts))
            c_gradient[j] = m.contexts.T @ summed
            r_gradient += summed @ m.matrices[j].T
        for x, g, s in zip(m.parts(), (r_gradient, c_gradient, g_targets, g_bias, u_targets, u_bias), self.squares, strict=True):
            g /= n
            s += g * g
            x += RATE * g / np.sqrt(s)
        self.tokens += n

    @staticmethod
    def _contrast(h: np.ndarray, chosen: np.ndarray, targets: np.ndarray, bias: np.ndarray, shift: np.ndarray):
        """Gradients of what is ``chosen``, a sorted row of ``targets`` for each row of ``h``: of h, targets and bias."""
        met = targets[chosen]
        with np.errstate(over="ignore"):
            up = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, met) + (bias - shift.astype(np.float32))[chosen]))
        starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        g_targets = np.zeros_like(targets)
        g_targets[chosen[starts]] = np.add.reduceat(up[:, None] * h, starts)
        met *= up[:, None]
        return met, g_targets, np.bincount(chosen, up, len(targets)).astype(np.float32)

    def _against(self, h, back, targets, bias, share, g_targets, g_bias) -> None:
        """Add the gradients of noise drawn by ``share``, which all rows have in common, in place."""
        noise = np.searchsorted(np.cumsum(share[:-1]), self.rng.random(NOISE))
        met = targets[noise]
        values = h @ met.T
        values += (bias[noise] - np.log(NOISE * share[noise])).astype(np.float32)
        with np.errstate(over="ignore"):
            down = -1 / (1 + np.exp(np.negative(values, out=values), out=values))
        back += down @ met
        np.add.at(g_targets, noise, down.T @ h)
        np.add.at(g_bias, noise, down.sum(axis=0))


def _summed(place: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``rows`` by ``place``, which is under 65536."""
    order = np.argsort(place.astype(np.uint16), kind="stable")
    held = place[order]
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[held[starts]] = np.add.reduceat(rows[order], starts)
    return out


def contexts_of(units: np.ndarray) -> np.ndarray:
    """The CONTEXT units before each token of a text, the nearest first; what lies before a text are ends."""
    padded = np.concatenate([np.zeros(CONTEXT, units.dtype), units])
    return np.stack([padded[CONTEXT - 1 - j : len(padded) - 1 - j] for j in range(CONTEXT)], axis=1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over the training documents, the end included. Tasks count before they shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"token": pa.array(list(held), pa.binary()), "c": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens_of(text.as_py()))
                if len(held) > HELD:
                    yield flushed()
        yield flushed()

    found = _training(docs).mapInArrow(count, "token binary, c long")
    return found.groupBy("token").agg(F.sum("c").alias("c"))


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), FOLDS)).select("text")


@dataclass(frozen=True)
class Words:
    """Frequent words by place: place 0 is the end, then by falling count."""

    places: dict[bytes, int]
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    unit_total: np.ndarray
    unit_distinct: np.ndarray

    def unit_of(self, word: bytes) -> int:
        place = self.places.get(word, -1)
        return place if 0 <= place <= WORDS else suffix_unit(word)

    def base(self, c):
        return np.log10((c + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def within(self, c, units):
        """log10 probability of a word with count ``c`` in its unit; a word that is a unit of its own has all of it."""
        return np.where(units <= WORDS, 0.0, np.log10((c + SMOOTH) / (self.unit_total[units] + SMOOTH * (self.unit_distinct[units] + 1))))

    def unigram(self) -> np.ndarray:
        """Training tokens of each unit."""
        found = np.array(self.unit_total, np.float64)
        found[: min(len(self.counts), WORDS + 1)] = self.counts[: WORDS + 1]
        return found


def words_of(counts: DataFrame) -> Words:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    end = counts.where(F.col("token") == F.lit(END)).first()
    top = sorted(_frequent(counts.where(F.col("token") != F.lit(END))), key=lambda r: (-r["c"], bytes(r["token"])))
    found = [bytes(r["token"]) for r in top]
    held = np.array([end["c"] if end else 0, *(r["c"] for r in top)], np.int64)
    sums = counts.where(F.col("token") != F.lit(END)).groupBy(_suffix_unit().alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    unit_total, unit_distinct = np.zeros(UNITS), np.zeros(UNITS)
    for r in sums:
        unit_total[r["k"]], unit_distinct[r["k"]] = r["n"], r["v"]
    for word, c in zip(found[:WORDS], held[1 : WORDS + 1].tolist(), strict=True):
        unit_total[suffix_unit(word)] -= c
        unit_distinct[suffix_unit(word)] -= 1
    places = {END: 0} | {w: i + 1 for i, w in enumerate(found)}
    return Words(places, held, total["n"], total["v"], unit_total, unit_distinct)


def _frequent(counts: DataFrame) -> list:
    """Rows of the most frequent tokens, at most FREQUENT: those from a count on that a histogram of counts gives.

    A top-k of that size would send as many rows from every task to the driver. Of tokens at the last level that
    doesn't fit whole, those of the smallest hashes are taken.
    """
    level = F.floor(F.log2("c") * 32).cast("int")  # a couple of thousand levels at most
    held, least, cut = 0, None, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if held + r["count"] > FREQUENT:
            cut = r["level"]
            break
        held, least = held + r["count"], r["level"]
    chosen = F.lit(False) if least is None else level >= least
    if cut is not None:
        bucket = F.pmod(F.xxhash64("token"), F.lit(4096))
        most = -1
        for r in sorted(counts.where(level == cut).groupBy(bucket.alias("b")).count().collect(), key=lambda r: r["b"]):
            held += r["count"]
            if held > FREQUENT:
                break
            most = r["b"]
        chosen = chosen | ((level == cut) & (bucket <= most))
    return counts.where(chosen).collect()


def _suffix_unit():
    return (F.crc32(F.substring("token", -SUFFIX, SUFFIX)) % SUFFIXES + (1 + WORDS)).cast("int")


class _Units:
    """Units of the tokens of texts, with those of frequent words at hand."""

    def __init__(self, words: Words):
        self.words = words
        self.held = np.array([words.unit_of(w) for w in words.places], np.int16)

    def __call__(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places, -1 if not frequent; units)."""
        get = self.words.places.get
        places = np.array([get(t, -1) for t in tokens], np.int64)
        units = self.held[places]
        rare = np.flatnonzero(places < 0)
        if len(rare):
            units[rare] = [suffix_unit(tokens[i]) for i in rare.tolist()]
        return places, units


PASS = (
    "row long, doc_id long, held_out boolean, turn int, n_tokens long, n_known long, base_score double, within double, "
    "rare array<binary>, times array<int>, units array<smallint>"
)


def tokenised(docs: DataFrame, sent) -> DataFrame:
    """PASS: each text's units, what the frequent words give to its scores, and its other words with their numbers."""
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int16()))
    schema = pa.schema([(x.split()[0], t) for x, t in zip(PASS.split(", "), types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, units_of = sent.value, _Units(sent.value)
        base, within = own.base(own.counts), own.within(own.counts, units_of.held)
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                columns: list[list] = [[] for _ in range(7)]
                for text in batch.column(2):
                    tokens = tokens_of(text.as_py())
                    places, units = units_of(tokens)
                    frequent = places >= 0
                    kept = places[frequent]
                    rare = Counter(tokens[i] for i in np.flatnonzero(~frequent).tolist())
                    values = (len(tokens), int((own.counts[kept] > 0).sum()), base[kept].sum(), within[kept].sum(), list(rare), list(rare.values()), units)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                rows = np.arange(row, row + batch.num_rows)
                row += batch.num_rows
                turns = pa.array((rows + TaskContext.get().partitionId()) % ROUNDS, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column(0), batch.column(1), turns, *(pa.array(c, t) for c, t in zip(columns, types[4:], strict=True))], schema=schema)

    common.short_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"), "text")
    return rows.mapInArrow(run, PASS)


def _contexts(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, units) of the texts of a column, one after another."""
    flat, ends = units.flatten().to_numpy(), np.cumsum(units.value_lengths().to_numpy())
    before = contexts_of(flat)
    # the first tokens of a text don't look into the one before
    for j in range(CONTEXT):
        for k in range(j + 1):
            at = ends[:-1] + k
            inside = at < ends[1:]
            before[at[inside], j] = 0
    return before, flat


def trained(first: DataFrame, unigram: np.ndarray) -> LogBilinear:
    """A model fitted on the texts of ``first`` (units, turn, held_out) that aren't held out.

    Each of ROUNDS rounds takes the documents of one turn, so every training token is seen once. Under LEAST_TOKENS tokens
    are seen several times, up to MOST_PASSES. Without training tokens all units are alike.
    """
    spark = first.sparkSession
    model = LogBilinear.started(unigram)
    total = unigram.sum()
    if not total:
        return model
    texts = first.where("not held_out")
    if total < LEAST_TOKENS:  # so little is one task's work, which goes over it several times
        passes = int(min(MOST_PASSES, 1 + np.ceil(LEAST_TOKENS / total)))
        return _averaged(texts.select("units"), spark.sparkContext.broadcast((model, None, unigram)), 1, 0, SMALL_BATCH, passes)[0]
    tasks = max(1, min(spark.sparkContext.defaultParallelism, int(total // (ROUNDS * LEAST_TOKENS))))
    step = int(min(BATCH, max(SMALL_BATCH, total / (ROUNDS * tasks) // STEPS)))
    squares = None
    for number in range(ROUNDS):
        own = texts.where(F.col("turn") == number).select("units")
        model, squares = _averaged(own, spark.sparkContext.broadcast((model, squares, unigram)), tasks, number, step)
    return model


def _averaged(texts: DataFrame, sent, tasks: int, number: int, step: int, passes: int = 1) -> tuple[LogBilinear, list[np.ndarray]]:
    """One round: every task trains on its texts from the sent model on, and the parameters are averaged block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, squares, unigram = sent.value
        model = LogBilinear(model.order, *(x.copy() for x in model.parts()))
        trainer = Trainer(model, unigram, squares and [x.copy() for x in squares], seed=number * 1000 + TaskContext.get().partitionId())
        rest: tuple = ()
        if passes > 1:  # under LEAST_TOKENS tokens in all
            batches = list(batches) * passes
        for batch in batches:
            before, after = _contexts(batch.column(0))
            if rest:
                before, after = np.concatenate([rest[0], before]), np.concatenate([rest[1], after])
            whole = len(after) // step * step
            for at in range(0, whole, step):
                trainer.step(before[at : at + step], after[at : at + step])
            rest = before[whole:], after[whole:]
        if rest and len(rest[1]):
            trainer.step(*rest)
        if not trainer.tokens:
            return
        rows = [(part, at, trainer.tokens, x[at : at + BLOCK].tobytes(), s[at : at + BLOCK].tobytes()) for part, (x, s) in enumerate(zip(model.parts(), trainer.squares, strict=True)) for at in range(0, len(x), BLOCK)]
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], names=["part", "at", "tokens", "x", "s"])

    def mean(table: pa.Table) -> pa.Table:
        weights = table["tokens"].to_numpy().astype(np.float64)
        weights /= weights.sum()
        sums = [sum(w * np.frombuffer(v.as_py(), np.float32).astype(np.float64) for w, v in zip(weights, table[c], strict=True)).astype(np.float32).tobytes() for c in ("x", "s")]
        return pa.table({"part": table["part"][:1], "at": table["at"][:1], "x": pa.array([sums[0]], pa.binary()), "s": pa.array([sums[1]], pa.binary())})

    found = texts.coalesce(tasks).mapInArrow(run, "part int, at int, tokens long, x binary, s binary")
    rows = found.groupBy("part", "at").applyInArrow(mean, "part int, at int, x binary, s binary").collect()
    model, squares, _ = sent.value
    parts = [x.copy() for x in model.parts()]
    held = [x.copy() for x in squares] if squares else [np.full(x.shape, 1e-4, np.float32) for x in parts]
    for r in rows:
        for arrays, data in ((parts, r["x"]), (held, r["s"])):
            shape = arrays[r["part"]].shape[1:]
            own = np.frombuffer(data, np.float32).reshape(-1, *shape)
            arrays[r["part"]][r["at"] : r["at"] + len(own)] = own
    return LogBilinear(model.order, *parts), held


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text).

    Learns from the documents whose CRC-32 of doc_id isn't a multiple of FOLDS; one without doc_id is learned from too.
    A null or empty text is its end alone; texts of any length are whole. Repeated rows count and are scored each; other
    columns are ignored. Without training documents every count is zero. An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.short_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = common.materialise(word_counts(docs), "word-counts")
    words = words_of(counts)
    first = common.materialise(tokenised(docs, spark.sparkContext.broadcast(words)), "lm-pass")
    sent = spark.sparkContext.broadcast(trained(first, words.unigram()))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                units = batch.column(7)
                each = sent.value.log10_probabilities(*_contexts(units))
                starts = np.concatenate([[0], np.cumsum(units.value_lengths().to_numpy())[:-1]])
                neural = np.add.reduceat(each, starts)  # a text has its end at least
                total = pa.array(neural + batch.column(6).to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(6)), total], names=names)

    passed = first.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "units")
    neural = passed.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")

    rare = first.select("row", F.inline(F.arrays_zip(F.col("rare").alias("token"), F.col("times").alias("times")))).toDF("row", "token", "times")
    c = F.coalesce("c", F.lit(0))
    totals = F.array(*[F.lit(float(words.unit_total[k] + SMOOTH * (words.unit_distinct[k] + 1))) for k in range(1 + WORDS, UNITS)])
    every = words.total + SMOOTH * (words.distinct + 1)
    sums = (
        rare.join(counts, "token", "left")
        .select(
            "row",
            F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"),
            (F.col("times") * F.log10((c + SMOOTH) / F.lit(float(every)))).alias("base"),
            (F.col("times") * F.log10((c + SMOOTH) / F.element_at(totals, _suffix_unit() - WORDS))).alias("within"),
        )
        .groupBy("row")
        .agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("within").alias("within"))
    )
    zero = F.lit(0.0)
    return neural.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(words.total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("within", zero)).alias("score"),
    )
