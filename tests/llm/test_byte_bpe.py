import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts():
    rng = random.Random(4)
    texts = ["", " ", "\n\n  a", "x" * 3000, "ab" * 700, " " * 900, "日本語" * 400, "\U0001f600" * 40, "don't WE'LL 123456789 ...!!", "<|endoftext|>", "é́‍"]
    texts += ["".join(rng.choices("abcdefgh ", k=rng.randint(1, 900))) for _ in range(25)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(128, 0x2FFF)])) for _ in range(400)) for _ in range(25)]
    return texts


def test_ids_equal_the_library(library):
    codec = byte_bpe.codec_at(PATH)
    for text, joined in zip(_texts(), byte_bpe.TextCodec(codec).encoded(_texts()), strict=True):
        ids = [int(x) for x in joined.split()]
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_memory_of_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    monkeypatch.setattr(byte_bpe, "GROUP", 50)
    got = [[int(x) for x in j.split()] for j in byte_bpe.TextCodec(byte_bpe.codec_at(PATH)).encoded(_texts())]
    assert got == [library.encode_ordinary(t) for t in _texts()]


def test_rows_round_trip(spark, library):
    rows = [(1, None), (2, ""), (3, "The same"), (3, "The same"), (None, "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, ids string")
    out = byte_bpe.encoded(docs)
    found = {(r["doc_id"], r["n_tokens"]): r for r in out.collect()}
    assert len(out.collect()) == 5 and found[1, 0]["ids"] == []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        r = found[i, len(ids)]
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r["text"] for r in byte_bpe.decoded(out).collect()) == sorted(t or "" for _, t in rows)
    assert byte_bpe.encoded(docs.limit(0)).collect() == []
