import math

import pytest

from lodestone.llm import url_filter as uf


def _probability(counts, text, side):
    """log P of text by the recursion, in plain Python; counts: {gram: (good, bad)}."""
    n = lambda s: counts.get(s, (0, 0))[side]
    total = sum(c[side] for g, c in counts.items() if len(g) == 1)
    logs = 0.0
    for i, c in enumerate(text):
        p = (n(c) + uf.SMOOTHING / uf.ALPHABET) / (total + uf.SMOOTHING)
        for k in range(1, uf.ORDER + 1):
            x = text[i - k : i]
            if i - k < 0 or x not in counts:
                break
            p = (n(x + c) + uf.SMOOTHING * p) / (n(x) + uf.SMOOTHING)
        logs += math.log(p)
    return logs


@pytest.mark.parametrize("share", [None, 2e-5, 0.05])
def test_scores_equal_the_recursion(spark, monkeypatch, share):
    monkeypatch.setattr(uf, "BROADCAST_SHARE", share)
    good, bad = ["http://a.net/de/1", "http://b.net/de/22", "http://a.net/de/x"], ["http://a.com/en/1", "http://q.com/en/"]
    labelled = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, good boolean")
    counts = {r["gram"]: (r["n_good"], r["n_bad"]) for r in uf.gram_counts(labelled).collect()}
    for s in ("a", "net", uf.START, "1" + uf.END):
        assert counts[s] == tuple(sum(f"{uf.START}{u}{uf.END}".count(s) for u in side) for side in (good, bad))
    grams = uf.gram_counts(labelled)
    table, base = uf.weights(grams)
    frequent = share and uf._frequent(grams)
    assert not share or frequent.count() == len(counts) or share > 0.01 and 0 < frequent.count() < len(counts)
    others = ["http://z.net/de/9", "ftp://q.com/en/1", "", "ü", *good]
    got = {r["url"]: r["score"] for r in uf.scored(spark.createDataFrame([(u,) for u in others], "url string"), table, base, frequent).collect()}
    contexts = {g: c for g, c in counts.items()}
    for u in others:
        text = f"{uf.START}{u}{uf.END}"
        want = (_probability(contexts, text, 0) - _probability(contexts, text, 1)) / len(text)
        assert got[u] == pytest.approx(want, abs=1e-9)


def test_rules_hosts_and_paths(spark):
    urls = [None, "", "no scheme", "http://COM/en/1", "https://x.com/en/", "http://www.example.com/en/77", "http://example.com/en/8", "http://notexample.com/en/7", "http://a.example.net/de/81?x", "http://b.net/de/1#y", "http://net", "http://b.net?/de/", "x://y.org/es/://z"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in uf.judged(rows).collect()}
    assert len(got) == len(urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("com", "/en/1", "com/en/"), ("x.com", "/en/", "com/en/"),
        ("www.example.com", "/en/77", "example.com/en/7"), ("example.com", "/en/8", "com/en/"), ("notexample.com", "/en/7", "com/en/"),
        ("a.example.net", "/de/81", "example.net/de/8"), ("b.net", "/de/1", "net/de/"), ("net", "", None), ("b.net", "", None), ("y.org", "/es/://z", "org/es/"),
    ]
    assert all(r["verdict"] == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}[r["rule"]] for r in got.values() if r["rule"])
    assert {r["verdict"] for r in got.values()} == {"allow", "block"} and got[0]["verdict"] == "allow"


def test_empty_and_one_sided(spark):
    empty = spark.createDataFrame([], "page_id long, url string, score string")
    assert uf.judged(empty).collect() == []
    one = spark.createDataFrame([(1, "http://a.fr/x", "clash"), (1, "http://a.fr/x", "clash")], "page_id long, url string, verdict string")
    assert [r["verdict"] for r in uf.judged(one).collect()] == ["allow", "allow"]
