import hashlib

from lodestone.llm import exact_dedup


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, keep_id string, kept int")


def test_groups_nulls_repeats_and_clashing_names(spark):
    rows = [(9, "a  b"), (4, "a\t\nb"), (7, "a b "), (1, None), (2, ""), (3, " \x0b"), (5, "x" * 200_000), (6, "x" * 200_000), (4, "a\t\nb"), (None, "a b"), (None, "alone")]
    out = exact_dedup.exact_duplicates(_docs(spark, rows)).collect()
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in out)
    assert got == sorted([
        (9, 4, 4, False), (4, 4, 4, True), (4, 4, 4, True), (7, 7, 1, True), (1, 1, 2, True), (2, 1, 2, False),
        (3, 3, 1, True), (5, 5, 2, True), (6, 5, 2, False), (-1, 4, 4, False), (-1, -1, 1, True),
    ])
    assert {r["text_sha256"] for r in out if r["doc_id"] == 7} == {hashlib.sha256(b"a b ").hexdigest()}
    kept = exact_dedup.drop_exact_duplicates(_docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "kept"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 7]


def test_a_digest_collision_is_found_by_the_bytes(spark, monkeypatch):
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: real(exact_dedup.F.substring(column, 1, 1), bits))
    out = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(_docs(spark, [(1, "ab"), (2, "ac"), (3, "ac"), (4, "ab"), (5, "z")])).collect()}
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in out.items()} == {1: (1, 2, True), 4: (1, 2, False), 2: (2, 2, True), 3: (2, 2, False), 5: (5, 1, True)}


def test_runs_merge_and_empty(spark):
    index = exact_dedup.MergeIndex(spark, exact_dedup.common.scratch(spark, "test-index"))
    for batch in ([(3, b"d"), (8, b"e")], [(2, b"d")], [(9, b"e"), (1, b"f")]):
        index.flush(spark.createDataFrame(batch, "doc_id long, digest binary"))
    assert sorted((bytes(r["digest"]), r["keep_id"], r["group_size"]) for r in index.entries().collect()) == [(b"d", 2, 2), (b"e", 8, 2), (b"f", 1, 1)]
    assert exact_dedup.exact_duplicates(_docs(spark, [])).collect() == []


def test_ids_that_repeat_with_other_texts(spark):
    rows = [(1, "a"), (4, "a"), (4, "b"), (4, "b"), (5, "b"), (2, "c"), (2, "d"), (3, "d"), (None, "c"), (None, "d"), (None, "e"), (None, "e")]
    out = exact_dedup.exact_duplicates(_docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        own = [j for j, u in rows if u == t]
        keep = min((j for j in own if j is not None), default=None)
        want.append((i or -1, keep or -1, len(own), keep == i, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"], r["text_sha256"]) for r in out) == sorted(want)
    kept = exact_dedup.drop_exact_duplicates(_docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == sorted([(1, "a"), (4, "b"), (2, "c"), (2, "d"), (-1, "c"), (-1, "d"), (-1, "e"), (-1, "e")])


def test_filters_rule_out_what_no_other_run_has(spark):
    index = exact_dedup.MergeIndex(spark, exact_dedup.common.scratch(spark, "test-index"))
    batches = [[(k, f"{n}-{k}".encode()) for k in range(3000)] + [(n, b"in all")] for n in range(3)]
    for batch in batches:
        index.flush(spark.createDataFrame(batch, "doc_id long, digest binary"))
    for number in range(3):
        asked = index.maybe_in(index.runs[number], number, "own")
        assert asked.where("not own").isEmpty() and asked.count() == 3001
        others = index.maybe_in(index.runs[number], (number + 1) % 3, "other").where("other").count()
        assert 1 <= others < 0.15 * 3001
    found = {bytes(r["digest"]): (r["keep_id"], r["group_size"]) for r in index.compact().collect()}
    assert len(found) == 9001 and found[b"in all"] == (0, 3) and found[b"1-7"] == (7, 1)
