import re

from lodestone.llm import decontaminate

ITEM = [(1, " ".join(f"q{i}" for i in range(20))), (2, "Short ANSWER, here"), (10, " ".join(f"q{i}" for i in range(5, 30))), (3, None), (4, "?!"), (5, "ünï cödé wörds")]


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(text):
    words, hit, items = _words(text), set(), set()
    for item, t in ITEM:
        own = _words(t)
        for i in range(max(1, len(own) - 12) if own else 0):
            window = own[i : i + 13]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    items.add(str(item))
    return len(words), sorted(hit), sorted(items)


def test_equals_brute_force_and_maps_back(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", "...", "A short answer HERE ends", "short answer", long + " " + ITEM[0][1].upper().replace(" ", "--"), ITEM[0][1] + " " + ITEM[2][1], "xshort answer here", "ÜNÏ ünï cödé wörds", " ".join(f"q{i}" for i in range(4, 17)), ("short answer here " * 50_000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(*x, "z") for x in ITEM], "item_id long, text string, doc_id string")
    for size, parts in ((decontaminate.PART_BYTES, 1), (200, 4)):
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        assert decontaminate.Parts(bench).number >= parts
        out = decontaminate.overlaps(docs, bench).collect()
        assert sorted(r["doc_id"] for r in out) == list(range(len(texts)))
        for r in out:
            text = texts[r["doc_id"]]
            n, hit, items = _brute(text) if r["doc_id"] != 10 else (150_000, range(150_000), ["2"])
            assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), items)
            if r["doc_id"] != 10:
                assert sum(len(_words(text[s["start"] : s["end"]])) for s in r["spans"]) == len(hit)
        kept = decontaminate.without_contaminated(docs, bench)
        assert kept.columns == docs.columns
        clean = [i for i, t in enumerate(texts[:10]) if not (len(_brute(t)[1]) and 20 * len(_brute(t)[1]) >= _brute(t)[0])]
        assert sorted(r["doc_id"] for r in kept.collect()) == clean


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.report(docs, bench).first()
    assert (r["n_hit"], r["n_items"], r["contaminated"]) == (0, 0, False)
    assert decontaminate.report(docs.limit(0), bench).collect() == []


def test_items_without_an_id_and_repeats(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some answer stands here"), (1, "some answer stands here"), (None, "other words"), (2, "some answer and other words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "some answer"), (None, "other words"), (7, "some answer"), (7, "some answer"), (30, "Other WORDS")], "item_id long, text string")
    for size in (decontaminate.PART_BYTES, 10):
        monkeypatch.setattr(decontaminate, "PART_BYTES", size)
        out = sorted((r["doc_id"] or -1, r["n_hit"], r["items"]) for r in decontaminate.overlaps(docs, bench).collect())
        assert out == [(-1, 2, ["30", None]), (1, 2, ["7", None]), (1, 2, ["7", None]), (2, 4, ["30", "7", None])]
        assert sorted((r["doc_id"] or -1, r["n_items"]) for r in decontaminate.report(docs, bench).collect()) == [(-1, 2), (1, 2), (1, 2), (2, 3)]
