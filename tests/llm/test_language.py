import random
import zlib

import pytest

from lodestone.llm import language

SYLLABLES = {"aa": ["ka", "lo", "mi", "ru", "te"], "bb": ["zsch", "ein", "ung", "och"], "cc": ["eau", "oux", "que", "é"]}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(i, " ".join("".join(rng.choices(SYLLABLES[x], k=3)) for _ in range(30)), x) for i, x in enumerate(rng.choices(list(SYLLABLES), [6, 2, 1], k=600))]


def test_held_out_accuracy_and_rejects(spark, rows):
    more = [(900, None, "aa"), (901, "", "aa"), (902, "123 ²% _ !", "bb"), (903, "kalomi rutete", None), (None, "zscheinung ochung", "bb"), (904, "eauouxque " * 40_000, None)]
    docs = spark.createDataFrame([(*r, "q", 1.0) for r in rows + more], "doc_id long, text string, lang string, source string, score double")
    out = {r["doc_id"]: r for r in language.identified(docs).collect()}
    assert len(out) == len(rows) + len(more)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None) and not out[None]["held_out"]
    held = [(out[i]["lang_pred"], x) for i, _, x in rows if out[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    assert [(out[i]["lang_pred"], out[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert (out[903]["lang_pred"], out[904]["lang_pred"], out[None]["lang_pred"]) == ("aa", "cc", "bb")
    assert all(0 <= r["score"] <= 1 for r in out.values())
    kept = language.with_known_language(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(out) - {900, 901, 902}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.identified(docs).first()["lang_pred"] == "und"
    assert language.identified(docs.limit(0)).collect() == []


def test_presence_is_whole(monkeypatch):
    import numpy as np

    text = "".join(chr(97 + i * i % 26) for i in range(5000))
    whole, parts = np.zeros(language.BUCKETS, np.uint8), np.zeros(language.BUCKETS, np.uint8)
    language.presence(text, whole)
    monkeypatch.setattr(language, "SLICE", 64)
    language.presence(text, parts)
    assert (whole == parts).all() and whole.sum() > 26


def test_ridge_equals_explicit_kernels(rows):
    import numpy as np

    chosen = rows[:240]
    sets = []
    for _, text, _ in chosen:
        own = np.zeros(language.BUCKETS, np.uint8)
        language.presence(text, own)
        sets.append(set(np.flatnonzero(own).tolist()))
    bits = [np.packbits(np.isin(np.arange(language.BUCKETS), list(x)).astype(np.uint8)).tobytes() for x in sets]
    train, fresh = range(200), range(200, 240)
    labels = [chosen[i][2] for i in train]
    model = language.solved(labels, [bits[i] for i in train])
    names = sorted(set(labels))
    kernel = lambda a, b: len(sets[a] & sets[b]) / (len(sets[a]) * len(sets[b])) ** 0.5
    marks = [i for i in train if sum(labels[j] == labels[i] for j in range(i + 1)) <= language.LANDMARKS // len(names)]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors @ np.diag([1 / v**0.5 if v > 1e-6 * values.max() else 0 for v in values]) @ vectors.T
    features = lambda part: np.array([[kernel(a, b) for b in marks] for a in part]) @ root
    weight = np.array([1 / labels.count(x) for x in labels])
    weight /= weight.mean()
    target = np.array([[1 if x == n else -1 for n in names] for x in labels])
    x = features(train)
    centre, mean = (weight @ x) / weight.sum(), (weight @ target) / weight.sum()
    gram = (x - centre).T @ np.diag(weight) @ (x - centre) + language.RIDGE * len(labels) / 100 * np.eye(len(marks))
    solution = np.linalg.solve(gram, (x - centre).T @ np.diag(weight) @ (target - mean))
    want = (features(fresh) - centre) @ solution + mean
    got_names, got_scores = model.predict([chosen[i][1] for i in fresh])
    assert got_names == [names[k] for k in want.argmax(axis=1)]
    assert got_scores == pytest.approx(np.clip((want.max(axis=1) + 1) / 2, 0, 1).tolist(), abs=2e-3)


def test_the_stage_fills_unknown_languages(spark, rows):
    more = [(900, None, "aa"), (901, "12", None), (902, "kalomi rutete", None), (903, "zscheinung ochung", "xx"), (903, "eauoux", None)]
    docs = spark.createDataFrame([(x, i, t) for i, t, x in rows + more], "lang string, doc_id long, text string")
    out = {(r["doc_id"], r["text"]): r["lang"] for r in language.with_known_language(docs).collect()}
    assert {k: v for k, v in out.items() if k[0] >= 900} == {(902, "kalomi rutete"): "aa", (903, "zscheinung ochung"): "xx", (903, "eauoux"): "cc"}
    assert all(out[i, t] == x for i, t, x in rows)
    unknown = spark.createDataFrame([(1, "words", None), (2, "..", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.with_known_language(unknown).collect()] == [(1, "words", None)]
