import random
import re

import numpy as np
import xxhash

from lodestone.llm import components, simhash


def _brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _brute_components(rows):
    """Smallest id reachable for (id, fp) rows, by comparing all pairs."""
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, x in rows:
            low = min(label[j] for j, y in rows if (x ^ y).bit_count() <= 3)
            if low < label[i]:
                label[i], changed = low, True
    return label


def test_fingerprints_equal_brute_force():
    rng = random.Random(7)
    words = ["Ab", "ab", "É", "x y", "日本", "z", "\x1f"]
    texts = [None, "", " \t\n", "one", "One  two", "a b c", "\x0b\x0c"] + [" ".join(rng.choices(words, k=rng.randint(1, 700))) for _ in range(40)]
    for text in texts:
        assert simhash.fingerprint(simhash.shingle_hashes(text)) == _brute_fingerprint(text)


def _flip(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def test_spanning_links_connect_the_same_parts():
    rng = random.Random(3)
    for size in (1, 2, 30, 63, 300):
        centres = [rng.getrandbits(64) for _ in range(3)]
        values = list({_flip(rng, rng.choice(centres), rng.randint(0, 7)) for _ in range(size)})
        want = _brute_components(list(enumerate(values)))
        forest = simhash._Forest(len(values))
        for a, b in simhash.spanning_links(values):
            assert (values[a] ^ values[b]).bit_count() <= 3
            forest.link(a, b)
        assert [forest.root(i) for i in range(len(values))] == [want[i] for i in range(len(values))]


def test_tree_search_follows_enough_edges():
    rng = random.Random(5)
    values = list({_flip(rng, 0, rng.randint(0, 12)) for _ in range(400)})
    tree = simhash.BKTree(values)
    got = {(int(q), int(n)) for at, node in tree.within_all(np.array(values, np.uint64)) for q, n in zip(at, node, strict=True)}
    want = {(i, j) for i, x in enumerate(values) for j, y in enumerate(values) if (x ^ y).bit_count() <= 3}
    assert got == want
    assert {n for n in tree.within(values[0])} == {j for i, j in want if i == 0}


def test_components_of_links_with_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = list({*(_flip(rng, centre, rng.randint(0, 6)) for _ in range(120)), *(rng.getrandbits(64) for _ in range(50))})
    rows = [(i * 10 + 3, fp) for i, fp in enumerate(fps)]
    signed = [(fp - (1 << 64) if fp >> 63 else fp, i) for i, fp in rows]
    found = simhash.links(spark.createDataFrame(signed, "fp long, rep long"))
    got = {r["node"]: r["component"] for r in components.connected_components(found).collect()}
    want = _brute_components(rows)
    assert {i: got.get(i, i) for i, _ in rows} == want


def test_near_duplicates_edge_cases(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (9, base + " more"), (2, "quite another text than these"), (7, None), (8, "  "), (2, "quite another text than these"), (None, base), (None, "alone it stands here"), (30, base * 40)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by_id[7]["fingerprint"] == "0" * 16 and by_id[8]["component_id"] == 7
    assert by_id[2]["component_id"] == 2
    assert sorted(r["component_id"] or -1 for r in out if r["doc_id"] is None) == [-1, by_id[5]["component_id"]]
    prints = {i: _brute_fingerprint(t) for i, t in rows if i is not None}
    want = _brute_components(list(prints.items()))
    assert {i: r["component_id"] for i, r in by_id.items()} == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if want[i] == i)
    assert ids.count(None) == 2


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(7, 7), (200, 201), (201, 200)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}, 200: 200, 201: 200}


def test_near_duplicates_of_ids_that_repeat(spark):
    long = " ".join(f"w{i * i % 997}" for i in range(900))
    other = " ".join(f"v{i * i % 991}" for i in range(900))
    rows = [(1, long, "a"), (4, long + " more", "b"), (4, other, "c"), (5, other + " x", "d"), (4, other, "e"), (None, other, "f"), (None, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())
    assert got == sorted([(1, long), (4, other), (-1, other), (-1, "")])
