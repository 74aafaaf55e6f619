"""Series, feeds in other formats, changes by key, segments, tokenizers and declared joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import query, series, text, vector
from lodestone.operators import dml, documents, joins
from lodestone.session import scratch, table
from lodestone.sources import catalog, files

from .base import Book
from .ingest import _UPSERT, _commands, _customers

book = Book()


@book.add(
    "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, round(max(value), 6) AS value FROM events "
    "WHERE event_type IN ('view', 'click') AND user_id NOT IN (3, 4) GROUP BY ALL"
)
def series_downsampled(spark, sf):
    rows = series.tagged(table(spark, sf, "events"), {"event_type": "view|click", "user_id": "!3|4", "props": "*"})
    found = series.downsampled(rows, "ts", ["event_type"], "value", "6 hours", "max")
    return found.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.round("value", 6).alias("value"))


@book.add(
    "WITH s AS (SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL) "
    "SELECT event_type, start, round((n - lag(n) OVER w) / (epoch(start) - epoch(lag(start) OVER w)), 8) AS rate FROM s WINDOW w AS (PARTITION BY event_type ORDER BY start)"
)
def series_rate(spark, sf):
    counts = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return series.rate(counts, "start", ["event_type"], "n").select("event_type", "start", F.round("rate", 8).alias("rate"))


@book.add("SELECT s_suppkey, s_name, [s_nationkey, s_suppkey % 7] AS codes FROM supplier")
def separated_feed(spark, sf):
    """Lines with a feed's own separators."""
    path = scratch(spark, "separated")
    codes = F.array_join(F.array(F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 7).cast("string")), ";")
    lines = table(spark, sf, "supplier").select(F.concat_ws("##", F.col("s_suppkey").cast("string"), "s_name", codes).alias("value"))
    lines.write.option("lineSep", "|\n").text(path)
    return files.read_separated(spark, path, {"s_suppkey": "bigint", "s_name": "string", "codes": "array<bigint>"}, "##", "|\n", ";")


@book.add("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 200000")
def document_export(spark, sf):
    path = scratch(spark, "export")
    files.export_documents(table(spark, sf, "orders"), path, F.col("o_totalprice") > 200000, ["o_orderkey", "o_orderpriority"])
    return files.read_documents(spark, path, {"o_orderkey": "bigint", "o_orderpriority": "string"}).drop("CMD")


@book.add(_UPSERT)
def direct_table(spark, sf):
    """Commands written into a table, which is then read."""
    return dml.applied_to(scratch(spark, "direct"), _customers(spark, sf), _commands(table(spark, sf, "orders")), "id", "seq")


@book.add("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (3, 5, 8)")
def delete_by_key(spark, sf):
    keys = dml.keys_of("s_suppkey IN (3, 5, 8) AND s_name IS NOT NULL", "s_suppkey")
    return dml.deleted(table(spark, sf, "supplier"), F.col("s_suppkey").isin([int(k) for k in keys])).select("s_suppkey", "s_name")


@book.add(
    "SELECT c_custkey, coalesce(arg_max(price, o_orderkey) FILTER (WHERE price IS NOT NULL), any_value(c_acctbal)) AS c_acctbal, coalesce(arg_max(o_orderpriority, o_orderkey), any_value(c_mktsegment)) AS c_mktsegment "
    "FROM customer LEFT JOIN (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price FROM orders) ON o_custkey = c_custkey GROUP BY c_custkey"
)
def attribute_patches(spark, sf):
    """The newest patch of each attribute over the table's rows."""
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    patches = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", price.alias("c_acctbal"), F.col("o_orderpriority").alias("c_mktsegment"))
    return dml.patched(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), patches, "c_custkey", "o_orderkey")


@book.add("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def segment_merge(spark, sf):
    """Segments of rows merged into one that has the newest row of each key."""
    events, paths = table(spark, sf, "events").select("user_id", "event_id", "event_type"), []
    for k in range(3):
        paths.append(scratch(spark, "segment"))
        events.where(F.pmod("event_id", F.lit(3)) == k).write.parquet(paths[-1])
    return dml.compacted(spark, paths, scratch(spark, "merged"), "user_id", "event_id")


@book.add("SELECT p_partkey, string_split(p_name, ' ') AS words, list_transform(range(1, len(string_split(p_name, ' '))), lambda i: string_split(p_name, ' ')[i] || ' ' || string_split(p_name, ' ')[i + 1]) AS pairs FROM part")
def white_space_and_pairs(spark, sf):
    words = text.whitespace_tokens(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", words.alias("words"), text.word_ngrams(words, 2).alias("pairs"))


@book.add("SELECT c_custkey, tier FROM customer JOIN (VALUES (-1000.0, 'low'), (0.0, 'middle'), (5000.0, 'high')) t(least, tier) ON c_acctbal >= least AND c_custkey % 7 <> length(tier)")
def non_equi_join(spark, sf):
    tiers = spark.createDataFrame([(-1000.0, "low"), (0.0, "middle"), (5000.0, "high")], "least double, tier string")
    held = (F.col("c_acctbal") >= F.col("least")) & (F.col("c_custkey") % 7 != F.length("tier"))
    return joins.theta_join(table(spark, sf, "customer"), tiers, held).select("c_custkey", "tier")


@book.add("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def declared_main_aux(spark, sf):
    path = scratch(spark, "aux")
    table(spark, sf, "nation").where("n_nationkey < 20").write.parquet(path)
    main, aux = catalog.TableSpec("m", f"{sf}/customer.parquet"), catalog.TableSpec("a", path, "kv", "n_nationkey")
    catalog.MainAux("customer_with_nation", main, aux, "c_nationkey").publish(spark)
    return spark.sql("SELECT c_custkey, n_name FROM customer_with_nation")


@book.add("SELECT l_orderkey, any_value(o_custkey) AS o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def arbitrary_of_equal(spark, sf):
    both = table(spark, sf, "lineitem").select("l_orderkey").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("l_orderkey").agg(F.any_value("o_custkey").alias("o_custkey"))


@book.add("SELECT doc_id, text AS again, text AS wide, sha256(coalesce(text, '')) AS line FROM documents")
def encodings(spark, sf):
    """Texts through base64 and another charset and back."""
    rows = table(spark, sf, "documents").select("doc_id", "text", F.base64(F.encode("text", "UTF-8")).alias("packed"))
    rows = documents.from_base64(rows, ["packed"]).withColumn("wide", documents.encoded(F.col("text"), "UTF-16"))
    line = documents.line_fields(F.concat_ws("\x01", F.lit("x"), F.sha2(F.coalesce("text", F.lit("")), 256)), ["a", "line"], "\x01")
    return rows.select("doc_id", documents.decoded(F.col("packed"), "UTF-8").alias("again"), documents.decoded(F.col("wide"), "UTF-16").alias("wide"), line[1])


@book.add("SELECT event_id FROM events WHERE (event_type = 'view' OR event_type = 'click') AND user_id >= 10 AND user_id < 40 AND NOT event_type = 'click'")
def raw_document_query_text(spark, sf):
    fields = {"type": query.value_field(F.col("event_type")), "user": query.value_field(F.col("user_id"))}
    return table(spark, sf, "events").where(query.matches("type:(view OR click) AND user:[10,40) ANDNOT type:click", fields)).select("event_id")


@book.add("SELECT doc_id, 64 AS size, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) > 0 AS unit FROM documents")
def embedded_documents(spark, sf):
    """Every text with an embedding, whose length is one if the text has words."""
    found = vector.embedded(table(spark, sf, "documents").select("doc_id", "text"), "text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return found.select("doc_id", F.size("embedding").alias("size"), (F.abs(norm - 1) < 1e-3).alias("unit"))


QUERIES, ORACLE = book.queries, book.oracle
