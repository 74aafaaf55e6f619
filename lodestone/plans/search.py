"""Full-text, key-value and vector predicates, relevance and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import query, relevance, scalar, text, vector
from lodestone.session import table

from .base import Book

book = Book()

# the tokens of the library in DuckDB's words
_WORDS = r"""list_filter(string_split(translate(lower(coalesce(text, '')), E'\t\n\r.,;:!?|"''()[]{}', '                  '), ' '), lambda t: t <> '')"""
_D = f"d AS (SELECT doc_id, text, lang, source, n_chars, {_WORDS} AS w FROM documents)"
TERMS = ["the", "ingthe", "de"]


def _words(spark, sf, *columns):
    return table(spark, sf, "documents").withColumn("w", text.tokens(F.col("text"))).select("doc_id", "w", *columns)


@book.add(f"WITH {_D} SELECT doc_id, len(w) AS n_tokens, list_distinct(w[1:5]).len() AS early FROM d")
def tokenised(spark, sf):
    return _words(spark, sf).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct(F.slice("w", 1, 5))).cast("long").alias("early"))


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE list_has_any(w, ['thing', 'que', 'und'])")
def contain_any(spark, sf):
    return _words(spark, sf).where(scalar.contain(F.col("w"), "thing|que||und")).select("doc_id")


@book.add("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src7')")
def ha_in(spark, sf):
    return table(spark, sf, "documents").where(scalar.ha_in(F.col("source"), "src1|src7")).select("doc_id", "source")


@book.add("SELECT event_id FROM events WHERE list_has_any([event_type || ':' || (user_id % 5)::VARCHAR], ['view:1', 'click:3'])")
def pidvid_contain(spark, sf):
    pair = F.array(scalar.strcat(F.col("event_type"), ":", (F.col("user_id") % 5).cast("string")))
    return table(spark, sf, "events").where(scalar.pidvid_contain(pair, "view:1|click:3")).select("event_id")


@book.add("SELECT event_id FROM events WHERE event_type IN ('view', 'error') AND user_id % 7 = 3")
def kv_extract_match(spark, sf):
    pairs = F.concat(F.lit("kind:"), F.col("event_type"), F.lit(";rest:"), (F.col("user_id") % 7).cast("string"))
    return table(spark, sf, "events").where(scalar.kv_extract_match(pairs, ";", "kind", "view|error") & scalar.kv_extract_match(pairs, ";", "rest", "3")).select("event_id")


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE (list_contains(w, 'the') AND (list_contains(w, 'thing') OR list_contains(w, 'ti'))) AND NOT list_contains(w, 'und')")
def boolean_query(spark, sf):
    w = F.col("w")
    both = text.all_of(text.term(w, "the"), text.any_of(text.term(w, "thing"), text.term(w, "ti")))
    return _words(spark, sf).where(text.but_not(both, text.term(w, "und"))).select("doc_id")


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE list_contains(w, 'the')::INT + list_contains(w, 'thing')::INT + list_contains(w, 'on')::INT + list_contains(w, 'ti')::INT >= 3")
def weak_and(spark, sf):
    w = F.col("w")
    return _words(spark, sf).where(text.at_least(3, *[text.term(w, t) for t in ("the", "thing", "on", "ti")])).select("doc_id")


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def phrase(spark, sf):
    return _words(spark, sf).where(text.phrase(F.col("w"), "of", "the")).select("doc_id")


@book.add("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 500 AND n_chars < 800")
def number_range(spark, sf):
    return table(spark, sf, "documents").where(text.number_range(F.col("n_chars"), 500, 800, high_in=False)).select("doc_id", "n_chars")


@book.add(f"WITH {_D} SELECT doc_id, CASE WHEN list_contains(w, 'thing') THEN 2.5 ELSE 0 END + CASE WHEN list_contains(w, 'on') THEN 0.5 ELSE 0 END AS boost FROM d WHERE list_contains(w, 'the')")
def rank_boost(spark, sf):
    w = F.col("w")
    kept, score = text.boosted(text.term(w, "the"), (text.term(w, "thing"), 2.5), (text.term(w, "on"), 0.5))
    return _words(spark, sf).where(kept).select("doc_id", score.alias("boost"))


@book.add(f"WITH {_D} SELECT doc_id, len(list_filter(w, lambda t: t NOT IN ('the', 'de', 'und', 'of'))) AS n_kept FROM d")
def stop_words(spark, sf):
    words = text.tokens(F.col("text"), ("the", "de", "und", "of"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).cast("long").alias("n_kept"))


@book.add("SELECT n_nationkey, unnest(list_transform(range(1, length(n_name) + 1), lambda i: n_name[1:i])) AS prefix FROM nation")
def prefix_tokens(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.explode(text.prefixes(F.col("n_name"))).alias("prefix"))


@book.add("SELECT n_nationkey, unnest(list_transform(range(1, length(n_name) + 1), lambda i: n_name[i:])) AS suffix FROM nation")
def suffix_tokens(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.explode(text.suffix_prefixes(F.col("n_name"))).alias("suffix"))


_STATS = f"""WITH {_D}, s AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS al, {', '.join(f"greatest(sum(list_contains(w, '{t}')::INT), 1) AS df{i}" for i, t in enumerate(TERMS))} FROM d)"""
_TF = [f"len(list_filter(w, lambda t: t = '{t}'))" for t in TERMS]
_ANY = "list_has_any(w, [" + ", ".join(f"'{t}'" for t in TERMS) + "])"
_BM25 = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * 2.2 * {tf} / ({tf} + 1.2 * (0.25 + 0.75 * greatest(len(w), 1) / al))" for i, tf in enumerate(_TF))
_TFIDF = " + ".join(f"ln(n / df{i}) * {tf}" for i, tf in enumerate(_TF))


@book.add(f"{_STATS} SELECT doc_id, round({_BM25}, 6) AS score FROM d, s WHERE {_ANY}")
def bm25(spark, sf):
    return relevance.scored(_words(spark, sf), "w", TERMS, "bm25").select("doc_id", F.round("score", 6).alias("score"))


@book.add(f"{_STATS} SELECT doc_id, round({_BM25}, 6) AS score FROM d, s WHERE {_ANY} ORDER BY {_BM25} DESC, doc_id LIMIT 10")
def bm25_top10(spark, sf):
    found = relevance.scored(_words(spark, sf), "w", TERMS, "bm25").orderBy(F.desc("score"), "doc_id").limit(10)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@book.add(f"{_STATS} SELECT doc_id, round({_TFIDF}, 6) AS score FROM d, s WHERE {_ANY}")
def tfidf(spark, sf):
    return relevance.scored(_words(spark, sf), "w", TERMS, "tfidf").select("doc_id", F.round("score", 6).alias("score"))


@book.add(f"WITH {_D} SELECT doc_id, ({' + '.join(_TF)})::DOUBLE AS score FROM d WHERE {_ANY}")
def named_scorer(spark, sf):
    return relevance.scored(_words(spark, sf), "w", TERMS, "term_count").select("doc_id", "score")


def _fields():
    return {"body": query.words_field(F.col("w")), "lang": query.value_field(F.col("lang")), "size": query.value_field(F.col("n_chars"))}


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE list_contains(w, 'thing') OR (list_contains(w, 'the') AND list_contains(w, 'on') AND NOT list_contains(w, 'ti'))")
def query_text_precedence(spark, sf):
    """ANDNOT before AND before OR."""
    return _words(spark, sf, "lang", "n_chars").where(query.matches("thing OR the AND on ANDNOT ti", _fields(), "body")).select("doc_id")


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE (list_contains(w, 'the') OR contains(' ' || array_to_string(w, ' ') || ' ', ' de la ')) AND lang IN ('en', 'fr') AND n_chars >= 200 AND n_chars < 900")
def query_text_scope(spark, sf):
    held = query.matches("(body:the OR body:\"de la\") AND lang:(en OR fr) AND size:[200,900)", _fields())
    return _words(spark, sf, "lang", "n_chars").where(held).select("doc_id")


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE n_chars > 100 AND n_chars <= 2000 AND NOT lang = 'de'")
def query_text_ranges(spark, sf):
    return _words(spark, sf, "lang", "n_chars").where(query.matches("size:(100,) AND size:[,2000] ANDNOT lang:de RANK body:the", _fields())).select("doc_id")


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE (list_contains(w, 'the') OR lang = 'fr') AND list_contains(w, 'on') AND NOT n_chars <= 300")
def sp_query_match(spark, sf):
    return _words(spark, sf, "lang", "n_chars").where(query.sp_matches("(+(body:the|lang:fr)+body:on)!size:[,300]", _fields())).select("doc_id")


@book.add(f"WITH {_D} SELECT doc_id FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'thing')")
def match_index(spark, sf):
    return _words(spark, sf, "lang", "n_chars").where(query.match_index("body", "the thing", _fields())).select("doc_id")


PROBE = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"
_L2 = f"list_sum(list_transform(list_zip(embedding, {_VEC}), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))"
_IP = f"list_sum(list_transform(list_zip(embedding, {_VEC}), lambda p: p[1]::DOUBLE * p[2]))"


@book.add(f"SELECT vec_id, round({_L2}, 6) AS score FROM embeddings ORDER BY {_L2}, vec_id LIMIT 10")
def vector_top_l2(spark, sf):
    return vector.nearest(table(spark, sf, "embeddings"), "embedding", PROBE, 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@book.add(f"SELECT vec_id, round({_IP}, 6) AS score FROM embeddings WHERE label = 3 AND {_IP} >= 0.1 ORDER BY {_IP} DESC, vec_id LIMIT 10")
def vector_category_threshold(spark, sf):
    found = vector.nearest(table(spark, sf, "embeddings"), "embedding", PROBE, 10, "vec_id", "ip", F.col("label") == 3, 0.1)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@book.add(f"SELECT vec_id, round(CASE WHEN label < 3 THEN {_L2} ELSE 1000.0 END, 6) AS score FROM embeddings")
def vector_score(spark, sf):
    score = vector.vector_score(F.col("label") < 3, vector.squared_distance(F.col("embedding"), PROBE))
    return table(spark, sf, "embeddings").select("vec_id", F.round(score, 6).alias("score"))


_MANY = [[((i * (37 + k)) % 19 - 9) / 10 for i in range(64)] for k in range(3)]


def _l2(vector):
    return f"list_sum(list_transform(list_zip(embedding, [{', '.join(f'{x}::DOUBLE' for x in vector)}]), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))"


@book.add(" UNION ALL ".join(
    f"(SELECT {k} AS query, vec_id, round({_l2(v)}, 6) AS score FROM embeddings WHERE {'label IN (2, 5) AND ' if k == 1 else ''}{_l2(v)} <= 24 ORDER BY {_l2(v)}, vec_id LIMIT 7)" for k, v in enumerate(_MANY)
))
def vector_query_text(spark, sf):
    """Several vectors in one text, one of them limited to categories, with a number and a threshold."""
    parts = ["2,5#" * (k == 1) + ",".join(map(str, v)) for k, v in enumerate(_MANY)]
    found = vector.search(table(spark, sf, "embeddings"), "embedding", "vec_id", ";".join(parts) + "&n=7&sf=24", category="label")
    return found.select("query", "vec_id", F.round("score", 6).alias("score"))


_PAIR = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))"


@book.add(
    f"SELECT q.vec_id AS query, e.vec_id, round({_PAIR}, 4) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 "
    f"QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_PAIR}, e.vec_id) <= 5"
)
def vector_search_exact(spark, sf):
    """The five nearest rows of every row whose id is divisible by 100: an index of one cell looks at all rows."""
    rows = table(spark, sf, "embeddings")
    found = vector.CellIndex(rows, "embedding", "vec_id", 1).search(rows.where("vec_id % 100 = 0"), 5, 1)
    return found.select("query", "vec_id", F.round("score", 4).alias("score"))


@book.add("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 100 = 0")
def vector_search_index(spark, sf):
    """The same through the cells nearest to each query; ``recalled`` tells that nine in ten of the exact rows were found."""
    rows = table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    exact = vector.CellIndex(rows, "embedding", "vec_id", 1).search(asked, 5, 1).select("query", "vec_id")
    found = vector.CellIndex(rows, "embedding", "vec_id").search(asked, 5).select("query", "vec_id", F.lit(1).alias("found"))
    counts = exact.join(found, ["query", "vec_id"], "left").agg(F.countDistinct("query").alias("queries"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recalled"))
    return counts


_LON, _LAT = "(c_custkey * 37 % 3600 / 10.0 - 180)", "(c_custkey * 91 % 1700 / 10.0 - 85)"


@book.add(f"SELECT c_custkey FROM customer WHERE 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(48.0) - radians({_LAT})) / 2), 2) + cos(radians({_LAT})) * cos(radians(48.0)) * pow(sin(radians(11.0 - {_LON}) / 2), 2)))) < 2500")
def spatial_circle(spark, sf):
    rows = table(spark, sf, "customer")
    return rows.where(scalar.distance_km(F.expr(_LON), F.expr(_LAT), 11.0, 48.0) < 2500).select("c_custkey")


@book.add(f"SELECT c_custkey FROM customer WHERE {_LON} > -20.05 AND {_LON} < 40.05 AND {_LAT} > -10.05 AND {_LAT} < 30.05")
def spatial_polygon(spark, sf):
    corners = [(-20.05, -10.05), (40.05, -10.05), (40.05, 30.05), (-20.05, 30.05)]
    return table(spark, sf, "customer").where(scalar.in_polygon(F.expr(_LON), F.expr(_LAT), corners)).select("c_custkey")


@book.add("SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 34)")
def doc_ids(spark, sf):
    ids = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21, 34)], "doc_id long")
    return table(spark, sf, "documents").select("doc_id", "lang").join(ids, "doc_id", "left_semi")


@book.add(f"WITH {_D} SELECT doc_id, i // 80 AS chunk, array_to_string(w[i + 1:least(i + 100, len(w))], ' ') AS content FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 20, 1), 80)) AS i FROM d WHERE len(w) > 0)")
def overlapping_chunks(spark, sf):
    """Chunks of 100 tokens that share 20 with the next."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 21, F.lit(0)), F.lit(80))
    rows = _words(spark, sf).where(F.size("w") > 0).select("doc_id", "w", F.explode(starts).alias("i"))
    return rows.select("doc_id", F.floor(F.col("i") / 80).alias("chunk"), F.array_join(F.slice("w", F.col("i") + 1, F.lit(100)), " ").alias("content"))


QUERIES, ORACLE = book.queries, book.oracle
