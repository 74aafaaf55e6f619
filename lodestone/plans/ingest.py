"""Changes, feeds, message topics, document processing and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import dml, documents
from lodestone.session import scratch, table
from lodestone.sources import files
from lodestone.streaming import ingest

from .base import Book

book = Book()


@book.add("SELECT * FROM nation UNION ALL SELECT s_suppkey + 1000, s_name, s_nationkey % 5 FROM supplier WHERE s_suppkey <= 5")
def insert_rows(spark, sf):
    new = table(spark, sf, "supplier").where("s_suppkey <= 5").select((F.col("s_suppkey") + 1000).cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name"), (F.col("s_nationkey") % 5).alias("n_regionkey"))
    return dml.inserted(table(spark, sf, "nation"), new)


@book.add("SELECT s_suppkey, CASE WHEN s_nationkey = 3 OR s_suppkey IN (5, 9) THEN 'moved' ELSE s_name END AS s_name, CASE WHEN s_nationkey = 3 OR s_suppkey IN (5, 9) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_rows(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    condition = (F.col("s_nationkey") == 3) | F.col("s_suppkey").isin(5, 9)
    return dml.updated(rows, condition, {"s_name": F.lit("moved"), "s_acctbal": F.lit(0.0)}).select("s_suppkey", "s_name", "s_acctbal")


@book.add("SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal < 0)")
def delete_rows(spark, sf):
    return dml.deleted(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0).select("s_suppkey")


@book.add('SELECT count(*) AS "ROWCOUNT" FROM supplier WHERE s_acctbal < 0')
def change_row_count(spark, sf):
    return dml.row_count(table(spark, sf, "supplier"), F.col("s_acctbal") < 0)


def _commands(rows):
    """Commands on customers made from orders: every order adds, updates or deletes its customer."""
    cmd = F.when(F.col("o_orderkey") % 7 == 0, dml.DELETE).when(F.col("o_orderkey") % 3 == 0, dml.ADD).otherwise(dml.UPDATE)
    return rows.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), cmd.alias("cmd"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"))


_UPSERT = """
WITH c AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 3 = 0 THEN 'add' ELSE 'update_field' END AS cmd,
                  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, o_totalprice AS price FROM orders),
b AS (SELECT *, max(CASE WHEN cmd <> 'update_field' THEN seq END) OVER (PARTITION BY id) AS base_at FROM c),
f AS (SELECT id, arg_min(cmd, seq) AS first, arg_max(status, seq) AS status, arg_max(price, seq) AS price FROM b WHERE base_at IS NULL OR seq >= base_at GROUP BY id),
t AS (SELECT c_custkey AS id, c_mktsegment AS status, c_acctbal AS price FROM customer)
SELECT coalesce(t.id, f.id) AS id, CASE WHEN f.first = 'add' THEN f.status ELSE coalesce(f.status, t.status) END AS status,
       CASE WHEN f.first = 'add' THEN f.price ELSE coalesce(f.price, t.price) END AS price
FROM t FULL JOIN f ON t.id = f.id WHERE f.first IS NULL OR f.first = 'add' OR (f.first = 'update_field' AND t.id IS NOT NULL)
"""


def _customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("price"))


@book.add(_UPSERT)
def upsert_batch(spark, sf):
    return dml.applied(_customers(spark, sf), _commands(table(spark, sf, "orders")), "id", "seq")


@book.add(_UPSERT)
def upsert_stream(spark, sf):
    return ingest.upserted(spark, _commands(ingest.events_of(spark, sf, "orders")), _customers(spark, sf), "id", "seq")


@book.add("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click') AND contains(props, '1')")
def filtered_stream(spark, sf):
    stream = ingest.events_of(spark, sf)
    kept = stream.where(documents.field_in(F.col("event_type"), "view|click") & documents.field_contains(F.col("props"), "1"))
    return ingest.drained(kept.select("event_id", "user_id", "event_type"), "filtered")


@book.add(
    "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events "
    "WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL"
)
def tumbling_windows(spark, sf):
    """Extension: hourly counts in append mode; the windows that end after the watermark stay open."""
    counts = ingest.drained(ingest.windowed_counts(ingest.events_of(spark, sf), "ts", "event_type", "1 hour"), "tumbling")
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


@book.add("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
          "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf):
    """Extension: sessions of a user that end after two hours without an event."""
    grouped = table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session.start").alias("start"), "n")


@book.add("SELECT s_suppkey, s_name, [s_nationkey, s_suppkey % 7] AS codes FROM supplier")
def document_feed(spark, sf):
    """Written as a feed of commands and read back, multi-value fields included."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.array(F.col("s_nationkey").cast("long"), F.col("s_suppkey") % 7).alias("codes"))
    path = scratch(spark, "feed")
    files.write_documents(rows, path, compression="gzip")
    found = files.read_documents(spark, path, {"s_suppkey": "bigint", "s_name": "string", "codes": "array<bigint>"})
    return found.where("CMD = 'add'").drop("CMD")


@book.add("SELECT event_id, user_id, value FROM events")
def message_topic(spark, sf):
    """Appended to a topic and read back as two hash ranges."""
    topic = scratch(spark, "topic")
    files.append_messages(table(spark, sf, "events").select("event_id", "user_id", "value", "ts"), topic, "user_id", "ts")
    low = files.read_messages(spark, topic, "event_id bigint, user_id bigint, value double", 0, 29999)
    return low.unionByName(files.read_messages(spark, topic, "event_id bigint, user_id bigint, value double", 30000, 65535))


@book.add("SELECT p_partkey, p_brand, p_type AS kind, CASE WHEN p_size % 5 = 0 THEN 'none' ELSE p_name END AS label, p_size <> 7 AS realtime, CASE WHEN p_size < 10 THEN 'small' WHEN p_brand = 'Brand#11' THEN 'brand' ELSE 'default' END AS chain FROM part")
def document_processors(spark, sf):
    rows = table(spark, sf, "part").withColumn("label", F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")))
    rows = documents.with_defaults(documents.copied(rows, {"p_type": "kind"}), {"label": "none"})
    rows = documents.with_build_type(rows, "p_size", "7")
    rows = documents.routed(rows, {"small": F.col("p_size") < 10, "brand": F.col("p_brand") == "Brand#11"})
    return rows.select("p_partkey", "p_brand", "kind", "label", "realtime", "chain")


@book.add("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def deduplicated_batch(spark, sf):
    return documents.deduplicated(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@book.add("SELECT event_id FROM events WHERE ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-20'")
def time_to_live(spark, sf):
    return documents.alive(table(spark, sf, "events"), "ts", 5 * 86400, F.lit("2024-01-20").cast("timestamp")).select("event_id")


@book.add("SELECT o_orderkey, list_filter(['o_orderstatus', 'o_totalprice'], lambda c: CASE c WHEN 'o_orderstatus' THEN o_orderkey % 3 = 0 AND o_orderstatus <> 'X' ELSE o_orderkey % 4 = 0 END) AS changed FROM orders")
def modified_fields(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    return documents.changed_fields(old, new, "o_orderkey")


@book.add("SELECT event_id FROM events WHERE event_type = 'view' AND regexp_matches(props, '\"k\": [0-9]{2}\\b') AND (user_id BETWEEN 10 AND 40 OR NOT value > 50)")
def raw_document_conditions(spark, sf):
    held = (F.col("event_type") == "view") & F.col("props").rlike('"k": [0-9]{2}\\b')
    return table(spark, sf, "events").where(held & (F.col("user_id").between(10, 40) | ~(F.col("value") > 50))).select("event_id")


@book.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def document_reclaim(spark, sf):
    gone = table(spark, sf, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(gone, "c_custkey", "left_anti")


@book.add("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def sorted_build(spark, sf):
    """Rewritten as few files sorted by key, which lets later scans skip row groups."""
    path = scratch(spark, "sorted-build")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rows.repartitionByRange("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey").write.parquet(path)
    return spark.read.parquet(path)


@book.add("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 4")
def partitioned_lookup(spark, sf):
    """Written by distribution key; the filter reads one folder."""
    path = scratch(spark, "by-nation")
    table(spark, sf, "customer").select("c_custkey", "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    return spark.read.parquet(path).where("c_nationkey = 4").select("c_custkey", "c_nationkey")


@book.add("SELECT r_regionkey, r_name FROM region")
def orc_table(spark, sf):
    path = scratch(spark, "orc")
    table(spark, sf, "region").select("r_regionkey", "r_name").write.orc(path)
    return spark.read.orc(path)


QUERIES, ORACLE = book.queries, book.oracle
