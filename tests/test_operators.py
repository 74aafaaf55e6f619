import pytest
from pyspark.sql import functions as F

from lodestone.functions import query, registry, relevance, scalar, series, text, vector
from lodestone.operators import dml, documents, joins, ranking, table_functions, tables
from lodestone.session import clear_scratch, scratch
from lodestone.sources import catalog, external, files
from lodestone.streaming import ingest

PHONES = ["huawei:4599", "xiaomi:2999:red", "oppo:3799", "apple:", "samsung", ":6999", ":", ""]


def test_trans_rows_splits_at_the_first_separator(spark):
    rows = spark.createDataFrame(list(enumerate(PHONES)), "nid int, brand_price string")
    for sep in (":", ""):
        got = tables.trans_rows(rows, "brand_price", sep).orderBy("nid").collect()
        assert [r["trans_cola"] for r in got] == ["huawei", "xiaomi", "oppo", "apple", "samsung", "", "", ""]
        assert [r["trans_colb"] for r in got] == ["4599", "2999:red", "3799", "", "", "6999", "", ""]


def test_multi_values(spark):
    rows = spark.createDataFrame([(1, [10, 20]), (2, []), (3, None)], "id int, v array<int>")
    assert sorted((r["id"], r["v"] or -1) for r in tables.unpack_multi_value(rows, "v").collect()) == [(1, 10), (1, 20), (2, -1), (3, -1)]
    held = spark.createDataFrame([("a\x1db",), ("",), (None,)], "t string").select(scalar.multi_value(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in held] == [["a", "b"], [], []]


def test_membership(spark):
    row = spark.createDataFrame([(["a", "b"], "x", "k1:v1|k2:v2")], "m array<string>, s string, kv string")
    got = row.select(
        scalar.contain(F.col("m"), "z|b").alias("a"), scalar.contain(F.col("m"), "").alias("b"), scalar.contain(F.col("m"), "z,b", ",").alias("c"), scalar.ha_in(F.col("s"), "y||x").alias("d"),
        scalar.kv_extract_match(F.col("kv"), "|", "k2").alias("e"), scalar.kv_extract_match(F.col("kv"), "|", "k2", "v1").alias("f"), scalar.kv_extract_match(F.col("kv"), "|", "k9").alias("g"), scalar.notin_string(F.col("s"), "x,y").alias("h"),
    ).first()
    assert [bool(x) for x in got] == [True, False, True, True, True, False, False, False]


def test_text_predicates(spark):
    rows = spark.createDataFrame([(1, "The cat, the DOG"), (2, "dog the cat"), (3, None)], "id int, t string").withColumn("w", text.tokens(F.col("t")))
    w = F.col("w")
    ids = lambda c: sorted(r["id"] for r in rows.where(c).collect())
    assert ids(text.phrase(w, "the", "cat")) == [1, 2] and ids(text.phrase(w, "cat", "the")) == [1]
    assert ids(text.at_least(9, text.term(w, "cat"), text.term(w, "dog"))) == [1, 2]
    assert ids(text.but_not(text.term(w, "the"), text.phrase(w, "dog", "the"))) == [1]
    assert rows.where("id = 3").first()["w"] == []
    grams = rows.select(text.word_ngrams(w, 2).alias("g"), "id").orderBy("id").collect()
    assert grams[1]["g"] == ["dog the", "the cat"] and grams[2]["g"] == []


def test_relevance_of_one_document(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "id int, w array<string>")
    import math

    score = relevance.with_bm25(docs, "w", ["a"]).first()["score"]
    assert score == pytest.approx(math.log(1 + 1.5 / 1.5) * 2.2 * 2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)))
    assert relevance.with_tfidf(docs, "w", ["a"]).first()["score"] == pytest.approx(math.log(2) * 2)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "id int, v array<float>")
    assert [r["id"] for r in vector.nearest(rows, "v", [0.0, 1.0], 2, "id").collect()] == [2, 1]
    assert [r["id"] for r in vector.nearest(rows, "v", [0.0, 1.0], 5, "id", "ip", within=2.0).collect()] == [3, 2]
    with pytest.raises(ValueError):
        vector.nearest(rows, "v", [0.0], 1, "id", "cosine")


def test_joins(spark):
    left = spark.createDataFrame([(1, [5, 7, 5]), (2, []), (3, None), (4, [9])], "id int, m array<int>")
    right = spark.createDataFrame([(5, "five"), (7, None)], "k int, v string")
    got = {r["id"]: r["out"] for r in joins.left_multi_join(left, "id", "m", right, "k", "v", "out").collect()}
    assert got == {1: ["five", None, "five"], 2: [], 3: [], 4: [None]}
    assert joins.multicast_join(left, "m", right, "k").count() == 2
    filled = joins.left_join_with_defaults(spark.createDataFrame([(5,), (7,), (8,)], "k int"), right, "k", {"v": "?"})
    assert {r["k"]: r["v"] for r in filled.collect()} == {5: "five", 7: None, 8: "?"}
    with pytest.raises(ValueError):
        joins.equi_join(left, right, [("id", "k")], "full")


def test_ranking(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i * 7 % 11)) for i in range(30)], "id int, g int, s double")
    brute = [(i, i % 3, float(i * 7 % 11)) for i in range(30)]
    want = sorted(i for g in range(3) for i, _, _ in sorted((r for r in brute if r[1] == g), key=lambda r: (-r[2], r[0]))[:2])
    assert sorted(r["id"] for r in ranking.rank_rows(rows, ["g"], "-s,+id", 2).collect()) == want
    assert ranking.mark_top(rows, "-s,+id", 4, "id").where("topKMark").count() == 4
    within = {g: [i for i, _, _ in sorted((r for r in brute if r[1] == g), key=lambda r: (-r[2], r[0]))] for g in range(3)}
    got = {r["id"] for r in ranking.spare_quota_rerank(rows, "g", {0: 3, 1: 2, 9: 4}, "-s,+id").collect()}
    rest = sorted((r for r in brute if r[0] in within[0][3:] + within[1][2:]), key=lambda r: (-r[2], r[0]))[:4]
    assert got == set(within[0][:3] + within[1][:2] + [r[0] for r in rest])
    with pytest.raises(ValueError):
        ranking.rank_rows(rows, ["g"], "s", 0)


def test_tables(spark):
    with pytest.raises(ValueError):
        tables.key_lookup(spark.range(3).toDF("k"), "k", [])
    assert tables.covers({"a"}, {"s"}, {"a"}, {"s"}, {"a", "s"}) and not tables.covers({"a"}, {"s"}, {"a", "b"}, set(), {"a"})
    got = tables.input_table(spark, "1,a,2:3;x,b,4", "i int, s string, v array<int>").collect()
    assert [(r["i"], r["s"], r["v"]) for r in got] == [(1, "a", [2, 3]), (None, "b", [4])]


def test_commands_in_order(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, s string, p double")
    commands = spark.createDataFrame(
        [(1, 1, "update_field", "A", None), (1, 2, "update_field", None, 9.0), (2, 1, "delete", None, None), (2, 2, "update_field", "x", None), (4, 1, "add", "d", None), (4, 2, "update_field", None, 4.0), (5, 1, "update_field", "e", 5.0), (3, 1, "delete", None, None), (3, 2, "add", "n", None)],
        "id int, seq int, cmd string, s string, p double",
    )
    assert sorted(tuple(r) for r in dml.applied(base, commands, "id", "seq").collect()) == [(1, "A", 9.0), (3, "n", None), (4, "d", 4.0)]


def test_processors_and_filters(spark):
    rows = spark.createDataFrame([(1, "x", ""), (2, None, "b")], "id int, a string, b string")
    assert [r["id"] for r in rows.where(documents.field_in(F.col("a"), "y|z", optional=True)).collect()] == [2]
    assert [r["b"] for r in documents.with_defaults(rows, {"b": "d"}).orderBy("id").collect()] == ["d", "b"]
    assert rows.select(documents.flip_halfwidth(F.lit("ＡＢ１")).alias("f")).first()["f"] == "ab1"
    half = documents.hash_percent(spark.range(1000).toDF("k"), "k", 50).count()
    assert 420 < half < 580


def test_feeds_and_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a=b", ["x", "y"]), (2, None, [])], "id int, s string, m array<string>")
    path = scratch(spark, "feed-test")
    files.write_documents(rows, path)
    got = {r["id"]: r for r in files.read_documents(spark, path, {"id": "int", "s": "string", "m": "array<string>"}).collect()}
    assert got[1]["s"] == "a=b" and got[1]["m"] == ["x", "y"] and got[2]["s"] is None and got[1]["CMD"] == "add"
    (tmp_path / "f").write_bytes(b"aabbccd")
    assert [bytes(r["record"]) for r in files.read_fixed_records(spark, str(tmp_path), 2).orderBy("at").collect()] == [b"aa", b"bb", b"cc"]


def test_query_texts(spark):
    rows = spark.createDataFrame([(1, "The red cat", 5, "en"), (2, "red and blue", 15, "fr"), (3, "blue cat", 25, "en"), (4, "dog", None, "de")], "id int, t string, n int, lang string").withColumn("w", text.tokens(F.col("t")))
    fields = {"t": query.words_field(F.col("w")), "n": query.value_field(F.col("n")), "lang": query.value_field(F.col("lang")), "attr2": query.value_field(F.col("n")), "name": query.words_field(F.col("w")), "index_2": query.words_field(F.col("w"))}
    ids = lambda c: sorted(r["id"] for r in rows.where(c).collect())
    words = lambda q, default="t": ids(query.matches(q, fields, default))
    signs = lambda q, default="t": ids(query.sp_matches(q, fields, default))
    assert words("red OR blue AND cat") == [1, 2, 3] and words("(red OR blue) AND cat") == [1, 3]
    assert words("red AND cat ANDNOT the") == [] and words("cat ANDNOT red") == [3]
    assert words('"red cat" OR t:dog') == [1, 4] and words("cat RANK dog") == [1, 3]
    assert words("n:[5,15]") == [1, 2] and words("n:(5,25)") == [2] and words("n:(5,)") == [2, 3] and words("lang:(en OR de) AND n:[,5]") == [1]
    assert signs("red|blue+cat") == [1, 2, 3] and signs("+red+cat+") == [1] and signs("cat!red") == [3] and signs("red#dog") == [1, 2, 4]
    assert signs("(+(attr2:15|name:cat)+index_2:blue)", None) == [2, 3]
    assert ids(query.match_index("t", "blue cat", fields)) == [3] and ids(query.match_index("t", "red dog", fields, any_of=True)) == [1, 2, 4]
    for bad in ("123456", "", "(red", "red)", "zz:red", "red AND", "AND red", "t:"):
        with pytest.raises(ValueError):
            query.matches(bad, fields)
        with pytest.raises(ValueError):
            query.sp_matches(bad, fields)
    with pytest.raises(ValueError):
        query.match_index("zz", "red", fields)


def test_scorers_by_name(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "id int, w array<string>")
    assert [(r["id"], r["score"]) for r in relevance.scored(docs, "w", ["a", "b"], "term_count").collect()] == [(1, 3.0)]
    relevance.SCORERS["length"] = lambda known: F.col("__length").cast("double")
    assert relevance.scored(docs, "w", ["c"], "length").first()["score"] == 1.0
    del relevance.SCORERS["length"]
    with pytest.raises(ValueError):
        relevance.scored(docs, "w", ["c"], "length")


def test_vector_texts_and_index(spark):
    wanted = vector.parsed("16,17#0.5,1;0,-2&n=3&sf=0.8")
    assert wanted == vector.VectorQuery(((0.5, 1.0), (0.0, -2.0)), (("16", "17"), ()), 3, 0.8)
    for bad in ("", "1,2;3", "1,2&k=4"):
        with pytest.raises(ValueError):
            vector.parsed(bad)
    import random

    rng = random.Random(1)
    data = [(i, [rng.gauss(c, 1) for c in ((i % 7) * 9, (i % 5) * 11, i % 3)]) for i in range(3000)]
    rows = spark.createDataFrame(data, "id int, v array<float>")
    asked = rows.where("id % 100 = 0")
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    exact = {q: {i for i, _ in sorted(data, key=lambda r: distance(r[1], v))[:5]} for q, v in data if q % 100 == 0}
    vector.PIECE, held = 100, vector.PIECE
    got: dict = {}
    for r in vector.CellIndex(rows, "v", "id", 20).search(asked, 5).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    vector.PIECE = held
    assert set(got) == set(exact) and all(len(x) == 5 for x in got.values())
    assert sum(len(got[q] & exact[q]) for q in exact) >= 0.95 * 5 * len(exact)


def test_left_multi_join_and_nulls_of_not_in(spark):
    left = spark.createDataFrame([(1, [1, 2]), (1, [3]), (None, [1])], "id int, m array<int>")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    out = joins.left_multi_join(left, "id", "m", right, "k", "v", "out").collect()
    assert sorted((r["id"] or -1, r["m"], r["out"]) for r in out) == [(-1, [1], ["a"]), (1, [1, 2], ["a", "b"]), (1, [3], ["c"])]
    rows = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    values = lambda *x: spark.createDataFrame([(v,) for v in x], "b int")
    ids = lambda df: sorted(r["a"] or -1 for r in df.collect())
    assert ids(joins.not_in(rows, "a", values(1, 7), "b")) == [2] and ids(joins.not_in(rows, "a", values(1, None), "b")) == [] and ids(joins.not_in(rows, "a", values(), "b")) == [-1, 1, 2]


def test_a_batch_that_runs_again_changes_nothing(spark):
    schema = "id int, seq int, cmd string, s string"
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    batches = [[(1, 1, "delete", None)], [(1, 2, "add", "new"), (2, 3, "update_field", "c")], [(2, 4, "update_field", "d"), (1, 5, "update_field", "newer")]]
    root = scratch(spark, "versions-test")
    table = ingest.VersionedTable(spark, root, base)
    for number in (0, 0, 1, 1):
        table.apply(spark.createDataFrame(batches[number], schema), number, "id", "seq")
    # a driver that starts again finds the versions, and the stream gives it the last batch once more
    table = ingest.VersionedTable(spark, root, base)
    for number in (1, 2):
        table.apply(spark.createDataFrame(batches[number], schema), number, "id", "seq")
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "newer"), (2, "d")]
    assert table.versions() == [0, 1, 2, 3]


def test_waiting_until_a_stream_is_fresh(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 1 AS k").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, k int").parquet(str(source))
    plain = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).option("path", str(out)).start()
    try:
        assert ingest.wait_until_fresh(plain) and spark.read.parquet(str(out)).count() == 1
        with pytest.raises(RuntimeError):
            ingest.wait_until_fresh(plain, "2024-01-01T00:00:00.000Z", 20)
    finally:
        plain.stop()
    counts = ingest.windowed_counts(stream, "ts", "k", "1 hour", late="10 minutes")
    marked = counts.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        assert ingest.wait_until_fresh(marked, "2024-01-01T09:50:00.000Z", 40)
        assert not ingest.wait_until_fresh(marked, "2024-01-02T00:00:00.000Z", 1)
    finally:
        marked.stop()


def test_record_and_encrypted_files(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(files, "RANGE_BYTES", 700)
    (tmp_path / "fixed").mkdir()
    data = bytes(i * 7 % 251 for i in range(10_003))
    (tmp_path / "fixed" / "a").write_bytes(data)
    got = files.read_fixed_records(spark, str(tmp_path / "fixed"), 10).orderBy("at").collect()
    assert [(r["at"], bytes(r["record"])) for r in got] == [(k, data[10 * k : 10 * k + 10]) for k in range(1000)]
    (tmp_path / "var").mkdir()
    records = [data[:k] for k in (0, 1, 300, 9_000, 5)]
    for name in ("a", "b"):
        (tmp_path / "var" / name).write_bytes(b"".join(len(r).to_bytes(4, "little") + r for r in records))
    got = files.read_length_prefixed_records(spark, str(tmp_path / "var")).orderBy("path", "at").collect()
    assert [bytes(r["record"]) for r in got] == records * 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a").write_bytes(b"\x09\x00\x00\x00abc")
    with pytest.raises(Exception, match="ends inside a record"):
        files.read_length_prefixed_records(spark, str(tmp_path / "bad")).collect()
    key = "0123456789abcdef"
    (tmp_path / "secret").mkdir()
    for name, body in (("plain", b"text one"), ("packed", gzip.compress(b"text two"))):
        secret = spark.createDataFrame([(bytearray(body),)], "b binary").select(F.aes_encrypt("b", F.lit(key).cast("binary")).alias("s")).first()["s"]
        (tmp_path / "secret" / name).write_bytes(bytes(secret))
    assert files.read_encrypted_files(spark, str(tmp_path / "secret" / "plain"), key).first()["text"] == "text one"
    assert files.read_encrypted_files(spark, str(tmp_path / "secret" / "packed"), key, compressed=True).first()["text"] == "text two"
    lines = spark.createDataFrame([(f"line {i}",) for i in range(50)], "l string")
    for compress in (False, True):
        path = scratch(spark, "secret-test")
        files.write_encrypted(lines, path, "l", key, compress, lines=7)
        assert sorted(r["line"] for r in files.read_encrypted(spark, path, key).collect()) == sorted(f"line {i}" for i in range(50))
        with pytest.raises(Exception):
            files.read_encrypted(spark, path, "fedcba9876543210").collect()


def test_external_tables(spark):
    url = "jdbc:derby:memory:outside;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(200).selectExpr("cast(id AS int) AS K", "concat('n', id) AS NAME").write.format("jdbc").option("url", url).option("dbtable", "things").options(**options).save()
    source = external.External(url, "things", "K", 0, 200, 4, options)
    rows = external.scan(spark, source)
    assert rows.count() == 200 and rows.rdd.getNumPartitions() == 4
    plan = rows.where("K = 7").select("NAME")._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(K), *EqualTo(K,7)]" in plan and "ReadSchema: struct<NAME:string>" in plan
    probe = spark.createDataFrame([(3, "x"), (5, "y"), (3, "z"), (999, "w"), (None, "v")], "K int, tag string")
    for most in (1000, 2):
        external.MOST_KEYS = most
        assert sorted(tuple(r) for r in external.lookup_join(probe, source, "K").collect()) == [(3, "x", "n3"), (3, "z", "n3"), (5, "y", "n5")]
    external.MOST_KEYS = 1000


def test_table_functions_and_formats(spark, caplog):
    import json
    import logging

    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    with caplog.at_level(logging.INFO):
        assert table_functions.call("printTableTvf", rows, 1).collect() == rows.collect()
    assert "id | s" in caplog.text and "1 | a" in caplog.text and "2 | None" not in caplog.text
    assert table_functions.call("identityTvf", rows) is rows
    counted = table_functions.call("tableMetricTvf", rows, "t")
    counted.collect()
    assert table_functions.METRICS["t"].get == {"rows": 2}
    for name, arguments in (("unknown", ()), ("printTableTvf", (-1,))):
        with pytest.raises(ValueError):
            table_functions.call(name, rows, *arguments)
    assert [json.loads(r["value"]) for r in catalog.formatted(rows, "json").collect()] == [{"id": 1, "s": "a"}, {"id": 2, "s": None}]
    assert catalog.formatted(rows, "full_json") == {"columns": ["id", "s"], "types": ["int", "string"], "rows": [[1, "a"], [2, None]]}
    assert catalog.formatted(rows, "table").to_pydict() == {"id": [1, 2], "s": ["a", None]}
    with pytest.raises(ValueError):
        catalog.formatted(rows, "xml")
    with pytest.raises(ValueError):
        ranking.ordered(rows, "-id")
    assert [r["id"] for r in ranking.ordered(rows.alias("t"), "t:-id", 1).collect()] == [2]
    assert rows.agg(registry.aggregate("spread", "id").alias("x")).first()["x"] == 1.0
    index = tables.AggregationTable(rows, ["id"], {"n": F.count(F.lit(1))})
    assert [tuple(r) for r in index.answer({"id": 2}, {"n": (1, 5)}).collect()] == [(2, 1)]
    with pytest.raises(ValueError):
        index.answer({"n": 1})


def test_scratch_is_cleared(spark):
    kept, gone = scratch(spark, "kept"), scratch(spark, "gone")
    for path in (kept, gone):
        spark.range(3).write.parquet(path)
    clear_scratch(spark, keep=(kept,))
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(gone).count()


def test_keys_patches_and_segments(spark):
    assert dml.keys_of("pk = 7 AND note = 'a or b'", "pk") == ["7"] and dml.keys_of("x > 1 and PK in (1, -2,3)", "pk") == ["1", "-2", "3"]
    assert dml.keys_of("pk = 'o''clock'", "pk") == ["o'clock"] and dml.keys_of("a.pk2 = 3 AND pk IN ('x','y')", "pk") == ["x", "y"]
    for bad in ("x = 1", "pk > 3", "pk = 1 OR x = 2", "other_pk = 3"):
        with pytest.raises(ValueError):
            dml.keys_of(bad, "pk")
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, p double")
    patches = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, 9.0), (1, 3, "y", None), (7, 1, "z", 1.0)], "id int, seq int, s string, p double")
    assert sorted(tuple(r) for r in dml.patched(rows, patches, "id", "seq").collect()) == [(1, "y", 9.0), (2, "b", 2.0)]


def test_series_and_joins_on_any_condition(spark):
    rows = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00', 'a', 1D), (timestamp'2024-01-01 00:00:30', 'a', 4D), (timestamp'2024-01-01 00:02:30', 'a', 16D), (timestamp'2024-01-01 00:00:10', 'b', 5D) AS t(ts, k, v)")
    mean = series.downsampled(rows, "ts", ["k"], "v", "1 minute")
    assert sorted((r["k"], r["start"].minute, r["v"]) for r in mean.collect()) == [("a", 0, 2.5), ("a", 2, 16.0), ("b", 0, 5.0)]
    assert sorted((r["k"], r["v"], r["rate"]) for r in series.rate(rows, "ts", ["k"], "v").where("rate is not null").collect()) == [("a", 4.0, 0.1), ("a", 16.0, 0.1)]
    assert series.tagged(rows, {"k": "!a"}).count() == 1 and series.tagged(rows, {"k": "a|b"}).count() == 4
    with pytest.raises(ValueError):
        series.downsampled(rows, "ts", ["k"], "v", "1 minute", "median")
    with pytest.raises(ValueError):
        joins.theta_join(rows, spark.range(20).toDF("i"), F.col("v") > F.col("i"), most=10)


def test_progress_of_a_stream(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    query_ = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query_.awaitTermination()
    found = ingest.progress(query_)
    assert found["rows"] == 7 and found["batch"] >= 0 and len(found["offsets"]) == 1


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b a a")], "id int, t string")
    found = {r["id"]: r["e"] for r in vector.embedded(rows, "t", "e").collect()}
    assert found[1] == pytest.approx(found[3]) and sum(found[2]) == 0 and sum(x * x for x in found[1]) == pytest.approx(1)


def test_embeddings_of_words_that_cancel_out_and_of_wide_spaces(spark):
    rows = spark.createDataFrame([(1, "w26 W58"), (2, "\xa0"), (3, "\x0b\u3000"), (4, " \t\n\f\r")], "id int, t string")
    found = {r["id"]: sum(x * x for x in r["e"]) for r in vector.embedded(rows, "t", "e").collect()}
    assert found == pytest.approx({1: 1, 2: 1, 3: 1, 4: 0})


def test_nearest_rows_of_copies_and_in_small_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    some = rng.normal(size=(40, 6)).astype(np.float32)
    vectors = {i: some[i * 7 % 40] if i % 3 else rng.normal(size=6).astype(np.float32) for i in range(400)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in sorted(vectors.items(), key=lambda x: -x[0])], "id int, v array<float>")
    held = np.array([vectors[i] for i in range(400)], np.float64)
    for piece, asked, some_rows in ((50_000, 256, 4096), (60, 3, 11)):
        for name, value in {"PIECE": piece, "ASKED": asked, "HELD": some_rows, "PAIRS": some_rows}.items():
            monkeypatch.setattr(vector, name, value)
        got = vector.CellIndex(rows, "v", "id", 1).search(rows.where("id % 10 = 1"), 4, 1).collect()
        want = {(q, int(i)) for q in range(1, 400, 10) for i in np.lexsort((np.arange(400), ((held - held[q]) ** 2).sum(axis=1)))[:4]}
        assert len(got) == 160 and {(r["query"], r["id"]) for r in got} == want


def test_distances_are_held_for_some_rows_at_a_time(monkeypatch):
    import numpy as np

    sizes, plain = [], vector._distances
    monkeypatch.setattr(vector, "_distances", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    rows = np.random.default_rng(1).normal(size=(9000, 4)).astype(np.float32)
    number, place, score = vector._nearest_of(rows[:600], rows, 1)
    assert max(sizes) <= vector.ASKED * vector.HELD
    assert number.tolist() == place.tolist() == list(range(600)) and not score.any()


def test_range_join_of_a_frequent_value_is_dealt_out(spark, monkeypatch):
    for name in ("LEFT", "RIGHT"):
        monkeypatch.setattr(joins, name, 50, raising=False)
    left = spark.createDataFrame([(i, 10.0 if i < 900 else float(i % 37) if i % 50 else None) for i in range(1000)], "a int, x double").coalesce(1)
    right = spark.createDataFrame([(i, i % 9 + 3.0, i % 9 + 10.5) for i in range(200)] + [(900, None, 3.0), (901, 12.0, 3.0)], "b int, low double, high double")
    met = joins.range_join(left, right, "x", "low", "high", 5.0)
    assert met.columns == ["a", "x", "b", "low", "high"]
    want = left.join(right, (left.x >= right.low) & (left.x < right.high))
    assert met.exceptAll(want).isEmpty() and want.exceptAll(met).isEmpty()
    sizes = [r["n"] for r in met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < sum(sizes) / 5
