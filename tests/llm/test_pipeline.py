import random

import corpus_pipeline

from . import test_byte_bpe, test_decontaminate, test_simhash

library = test_byte_bpe.library


def _write(spark, tmp_path, rows):
    docs = spark.createDataFrame([(i, t, x, "src", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(test_decontaminate.ITEM, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def _rows():
    rng = random.Random(12)
    words = {"en": ["the", "and", "thing", "with", "on"], "de": ["und", "der", "zung", "keit", "ein"]}
    rows = [(i, " ".join(rng.choices(words[x], k=60)), x) for i, x in enumerate(rng.choices(["en", "de"], k=60))]
    long = " ".join(rng.choices(words["en"], k=900))
    rows += [(100, long, "en"), (101, long + " thing", "en"), (102, long.replace(" ", "\n"), "en"), (103, "with " + test_decontaminate.ITEM[0][1], "en")]
    rows += [(104, None, "en"), (105, "", None), (106, "1234 %%", "en"), (107, "und der", None), (3, rows[3][1], rows[3][2])]
    return rows


def test_equals_brute_force(spark, tmp_path, library):
    rows = _rows()
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, _write(spark, tmp_path, rows)).collect()}
    kept = {}
    for i, t, _ in rows:
        if t and any(c.isalpha() for c in t):
            kept[i] = t
    first = {}
    for i in sorted(kept):
        first.setdefault(" ".join(x for x in kept[i].replace("\n", " ").split(" ")), i)
    kept = {i: kept[i] for i in first.values()}
    parts = test_simhash._brute_components([(i, test_simhash._brute_fingerprint(t)) for i, t in kept.items()])
    kept = {i: t for i, t in kept.items() if parts[i] == i}
    hit = {i: test_decontaminate._brute(t) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if not (len(hit[i][1]) and 20 * len(hit[i][1]) >= hit[i][0])}
    assert set(out) == set(kept) and not {101, 102, 103, 104, 105, 106} & set(out)
    assert all(out[i]["ids"] == library.encode_ordinary(t) for i, t in kept.items())


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    sf_dir = _write(spark, tmp_path, _rows())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if number + 1 < len(corpus_pipeline.STAGES):
            assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, empty, sf_dir).collect() == []
