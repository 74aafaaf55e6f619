"""Byte-level BPE encoding and decoding with numpy.

A text is split by the tokenizer's pattern. Pieces that a task hasn't met yet are encoded together: they are bucketed
by length and padded into matrices with one piece a row. In each round every row merges its leftmost pair of minimum
rank; pair ranks come from an open-addressing hash table held in arrays, and rows are compacted to the left after each
merge. Pieces longer than the largest bucket are merged by the same rule with a heap, which keeps them at n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Lengths of the padded matrices; longer pieces take the heap.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512)
#: Rows of one matrix at most.
ROWS = 8192
#: Pieces that a Python worker remembers in each of two generations, and their characters at most: some 100 MB each.
REMEMBERED, REMEMBERED_LENGTH = 250_000, 48
#: Characters of texts whose unmet pieces are merged together.
GROUP = 1_000_000
NO_RANK = np.int32(np.iinfo(np.int32).max)
PAD = np.int32(-1)


class PairTable:
    """Merged id of a pair of ids by linear probing; the table is at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NO_RANK, np.int32)
        left = np.arange(len(keys))
        slot = self._home(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several that want a slot the last gets it
            own = self.keys[slot] == keys[left]
            self.values[slot[own]] = values[left[own]]
            left, slot = left[~own], (slot[~own] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        slot = self._home(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.values[slot], NO_RANK)
        left = np.flatnonzero((met != keys) & (met >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            met = self.keys[slot[left]]
            hit = met == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (met >= 0)]
        return out


class Codec:
    """Encoder and decoder over the rank file at ``path``; an id is its token's rank."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = dict(zip(self.ids.values(), self.ids, strict=True))
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (self.ids[token[:i]], self.ids[token[i:]], rank)
            for token, rank in self.ids.items()
            for i in range(1, len(token))
            if token[:i] in self.ids and token[i:] in self.ids
        ]
        left, right, rank = np.array(pairs, np.int64).T
        self.width = int(max(self.ids.values()) + 2)
        self.table = PairTable(left * self.width + right, rank.astype(np.int32))
        self.pairs = {(a, b): r for a, b, r in pairs}

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: a piece that is a token is its id, others are merged."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ids.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > BUCKETS[-1]:
                out[i] = self._long(piece)
            else:
                by_length.setdefault(next(b for b in BUCKETS if len(piece) <= b), []).append(i)
        for bucket, places in by_length.items():
            step = max(1, min(ROWS, (ROWS * 64) // bucket))
            for at in range(0, len(places), step):
                some = places[at : at + step]
                for i, ids in zip(some, self._merged([pieces[i] for i in some], bucket), strict=True):
                    out[i] = ids
        return out

    def _merged(self, pieces: list[bytes], bucket: int) -> list[list[int]]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        held = np.frombuffer(b"".join(p.ljust(bucket, b"\0") for p in pieces), np.uint8).reshape(len(pieces), bucket)
        columns = np.arange(bucket)
        ids = np.where(columns < sizes[:, None], self.byte_ids[held], PAD)
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(pieces))
        done: list = [None] * len(pieces)
        while len(live):
            best = ranks.argmin(axis=1)  # the leftmost of the smallest
            rank = ranks[np.arange(len(live)), best]
            ended = rank == NO_RANK
            for k in np.flatnonzero(ended):
                done[live[k]] = ids[k, : sizes[k]].tolist()
            if ended.any():
                go = ~ended
                live, ids, ranks, sizes, best, rank = live[go], ids[go], ranks[go], sizes[go], best[go], rank[go]
                if not len(live):
                    break
                width = int(sizes.max())
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
            rows = np.arange(len(live))
            # compaction: what lies right of the pair moves one place to the left
            width = ids.shape[1]
            source = columns[:width] + (columns[:width] > best[:, None])
            ids = np.where(source < width, np.take_along_axis(ids, np.minimum(source, width - 1), 1), PAD)
            ids[rows, best] = rank
            sizes = sizes - 1
            gone = columns[: width - 1] + (columns[: width - 1] > best[:, None])
            ranks = np.where(gone < width - 1, np.take_along_axis(ranks, np.minimum(gone, width - 2), 1), NO_RANK)
            # only the pairs on both sides of the merged id are new
            after = np.where(best + 1 < width, ids[rows, np.minimum(best + 1, width - 1)], PAD)
            at = np.minimum(best, width - 2)
            fresh = self._pair_ranks(rank, after)
            ranks[rows, at] = np.where(best <= width - 2, fresh, ranks[rows, at])
            has = best > 0
            ranks[rows[has], best[has] - 1] = self._pair_ranks(ids[rows[has], best[has] - 1], rank[has])
        return done

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.width + right, -2)
        out = np.full(keys.shape, NO_RANK, np.int32)
        real = keys >= 0
        out[real] = self.table.ranks(keys[real])
        return out

    def _long(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = self.pairs
        heap = [(pairs[ids[i], ids[i + 1]], i, ids[i], ids[i + 1]) for i in range(n - 1) if (ids[i], ids[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:  # one of the two has been merged meanwhile
                continue
            ids[i], ids[j] = rank, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (found := pairs.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (found, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextCodec:
    """Encodes whole texts, remembering pieces with their ids in decimal."""

    def __init__(self, codec: Codec):
        self.codec, self.known, self.older = codec, {}, {}

    def encoded(self, texts: list[str | None]) -> Iterator[str]:
        """The decimal ids of each text, joined by single spaces; unmet pieces of several texts are merged together."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> Iterator[str]:
        split = self.codec.split
        pieces = [split(text) if text else [] for text in texts]
        fresh = self._unmet(pieces)
        known, long = self.known, {}
        for piece, ids in zip(fresh, self.codec.encode_pieces([p.encode() for p in fresh]), strict=True):
            (known if len(piece) <= REMEMBERED_LENGTH else long)[piece] = " ".join(map(str, ids))
        for own in pieces:
            yield " ".join(map(known.__getitem__, own) if not long else [known.get(p) or long[p] for p in own])

    def _unmet(self, pieces: list[list[str]]) -> list[str]:
        """Pieces without known ids. What the last generation knows is moved into this one as it is met."""
        met = set().union(*pieces)
        if len(self.known) + len(met) > REMEMBERED:
            self.older, self.known = self.known, {}
        fresh = met.difference(self.known)
        moved = fresh.intersection(self.older)
        self.known.update((p, self.older[p]) for p in moved)
        return list(fresh - moved)


@lru_cache(maxsize=2)
def codec_at(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def text_codec_at(path: str) -> TextCodec:
    """Kept by the worker process from task to task."""
    return TextCodec(codec_at(path))


def encoded(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs`` (doc_id, text).

    ``path`` is the rank file, which every executor has. The ids are decoded again, and ``decoded_sha256`` is of the
    bytes that come out. Null and empty texts have no tokens; texts of any length are whole; other columns are ignored.
    Rows that repeat are encoded each; an empty table gives no rows. Without ``keep_ids`` the ids aren't returned.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    fields = [("doc_id", pa.int64())] + [("ids", pa.list_(pa.int32()))] * keep_ids + [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = text_codec_at(path)
        codec = texts.codec
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, counts, digests, decoded = [], [], [], []
                for joined in texts.encoded(part.column(1).to_pylist()):
                    own = np.fromstring(joined, np.int32, sep=" ").tolist() if joined else []
                    counts.append(len(own))
                    digests.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(own)).hexdigest())
                    if keep_ids:
                        ids.append(own)
                columns = [part.column(0), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    common.short_batches(docs.sparkSession)
    result = "doc_id long, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, result)


def decoded(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for every row of ``encoded`` (doc_id, ids), other columns ignored.

    Null and empty ids give an empty text, an unknown id is an error, and bytes that aren't UTF-8, as ids cut in the
    middle of a character give, become replacement characters. An empty table gives no rows.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_at(path)
        for batch in batches:
            texts = [codec.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, text string")
