import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import lm_score


def _tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b""]


@pytest.mark.parametrize("frequent", [lm_score.FREQUENT, 420, 1000])
def test_scores_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)
    monkeypatch.setattr(lm_score, "HELD", 50)
    rng = random.Random(5)
    words = [f"w{i}x{'abcdefg'[i % 7]}" for i in range(900)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(900)], k=rng.randint(0, 200)))) for i in range(120)]
    rows += [(500, None), (501, "\t"), (502, "neverseen ÄÖ Ab"), (502, "neverseen ÄÖ Ab"), (503, "w1xb " * 20_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, token int")
    kept, real = [], lm_score.trained
    monkeypatch.setattr(lm_score, "trained", lambda *args: kept.append(real(*args)) or kept[-1])
    out = lm_score.scores(docs).collect()
    assert len(out) == len(rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(t for i, x in rows if not held(i) for t in _tokens(x))
    n, v = sum(c.values()), len(c)
    by_id = {r["doc_id"]: r for r in out}
    for i, text in rows:
        own, r = _tokens(text), by_id[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(c[t] > 0 for t in own), n, held(i))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), abs=1e-6)
    assert all(r["score"] < 0 for r in out)
    # every text by hand, with softmaxes over all units of a group
    words_ = lm_score.words_of(lm_score.word_counts(docs))
    model = kept[0]
    place_of = {int(u): k for k, u in enumerate(model.order)}

    def neural(units):
        total, before = 0.0, [0] * lm_score.CONTEXT + units
        for t, u in enumerate(units):
            past = [before[t + lm_score.CONTEXT - 1 - j] for j in range(lm_score.CONTEXT)]
            h = sum(model.contexts[v].astype(float) @ model.matrices[j].astype(float) for j, v in enumerate(past))
            g = place_of[u] // lm_score.GROUP
            own = slice(g * lm_score.GROUP, (g + 1) * lm_score.GROUP)
            for values, k in ((model.group_targets @ h + model.group_bias, g), (model.targets[own] @ h + model.bias[own], place_of[u] % lm_score.GROUP)):
                total += math.log10(math.exp(values[k]) / sum(map(math.exp, values)))
        return total

    for i, text in [r for r in rows if r[0] in (3, 17, 500, 501, 502)]:
        own = _tokens(text)
        units = [words_.unit_of(t) for t in own]
        want = neural(units) + sum(float(words_.within(c[t], np.array(u))) for t, u in zip(own, units, strict=True))
        assert by_id[i]["score"] == pytest.approx(want, abs=1e-3)


def test_probabilities_sum_to_one_and_learn():
    n = 300
    unigram = np.full(n, 100.0)
    trainer = lm_score.Trainer(lm_score.LogBilinear.started(unigram), unigram)
    rng = np.random.default_rng(1)
    units = np.zeros(lm_score.BATCH, np.int16)
    for k in range(1, len(units)):  # a unit depends on the two before it
        units[k] = (units[k - 1] + 7) % n if units[max(k - 2, 0)] % 2 else rng.integers(n)
    for _ in range(300):
        trainer.step(lm_score.contexts_of(units), units)
    model = trainer.model
    before = np.tile(np.array([[5, 3, 1]], np.int16), (n, 1))
    every = 10 ** model.log10_probabilities(before, np.arange(n, dtype=np.int16))
    assert every.sum() == pytest.approx(1, abs=1e-5)
    assert model.log10_probabilities(lm_score.contexts_of(units), units).mean() > 0.8 * math.log10(1 / n)


def _bigram(train, held):
    """Mean log10 probability of the held tokens by a bigram interpolated with the smoothed unigram, at its best weight."""
    c, pairs, after = Counter(), Counter(), Counter()
    for own in train:
        c.update(own)
        pairs.update(zip([b""] + own[:-1], own, strict=True))
        after.update([b""] + own[:-1])
    n, v = sum(c.values()), len(c)
    found = []
    for weight in (0.02, 0.05, 0.1, 0.2, 0.3, 0.5):
        values = []
        for own in held:
            for b, t in zip([b""] + own[:-1], own, strict=True):
                base = (c[t] + 0.1) / (n + 0.1 * (v + 1))
                w = weight if after[b] else 0
                values.append(math.log10((1 - w) * base + w * pairs[b, t] / max(1, after[b])))
        found.append(sum(values) / len(values))
    return max(found)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables aren't here")
def test_beats_base_and_on_texts_without_copies_a_bigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = {r["doc_id"]: r for r in lm_score.scores(docs).where("held_out").collect()}
    texts = {r["doc_id"]: _tokens(r["text"]) for r in docs.select("doc_id", "text").collect()}
    train = [x for i, x in texts.items() if i not in scored]
    per_token = lambda ids, name: sum(scored[i][name] for i in ids) / sum(scored[i]["n_tokens"] for i in ids)
    assert per_token(scored, "score") > per_token(scored, "base_score") + 0.1
    # a bigram knows by heart what also stands in the training texts, so only texts that don't are compared with it
    grams = lambda x: {tuple(x[k : k + 6]) for k in range(len(x) - 5)}
    known = set().union(*map(grams, train))
    fresh = [i for i in scored if len(grams(texts[i]) & known) <= 0.02 * len(grams(texts[i]))]
    assert len(fresh) >= 20
    assert per_token(fresh, "score") > _bigram(train, [texts[i] for i in fresh])


def test_empty_and_all_held_out(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.scores(docs).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm_score.scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0)
