"""The catalog, registered functions, hashes, samples and result formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import registry, scalar
from lodestone.operators import documents, table_functions, tables
from lodestone.session import scratch, table
from lodestone.sources import catalog, files

from .base import Book

book = Book()


@book.add("SELECT bucket, count(*) AS n FROM (SELECT CAST(floor(p_size / 10) AS INT) AS bucket FROM part) GROUP BY 1")
def registered_udf(spark, sf):
    registry.register(spark)
    return spark.sql("SELECT bucket_of(p_size, 10) AS bucket, count(*) AS n FROM {part} GROUP BY 1", part=table(spark, sf, "part"))


@book.add("SELECT s_nationkey, round(max(s_acctbal) - min(s_acctbal), 4) AS width FROM supplier GROUP BY 1")
def registered_udaf(spark, sf):
    return table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.round(registry.aggregate("spread", "s_acctbal"), 4).alias("width"))


@book.add("SELECT n_nationkey, 'name' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation")
def registered_udtf(spark, sf):
    registry.register(spark)
    nation = table(spark, sf, "nation")
    return spark.sql("SELECT n_nationkey, name, value FROM {nation}, LATERAL split_pairs(concat('name:', n_name, ';region:', n_regionkey), ';')", nation=nation)


@book.add("SELECT doc_id, source, n_chars FROM documents WHERE doc_id BETWEEN 10 AND 20")
def catalog_views(spark, sf):
    specs = [
        catalog.TableSpec("cat_docs", f"{sf}/documents.parquet", "summary", "doc_id", detail=("source", "n_chars")),
        catalog.TableSpec("cat_nation", f"{sf}/nation.parquet", "kv", "n_nationkey"),
        catalog.TableSpec("cat_events", f"{sf}/events.parquet", "series", "event_type", stamp="ts"),
    ]
    catalog.publish(spark, specs)
    return spark.sql("SELECT doc_id, source, n_chars FROM cat_docs_summary_ WHERE doc_id BETWEEN 10 AND 20")


@book.add("SELECT n_name || ' | ' || coalesce(CAST(r_name AS VARCHAR), 'null') AS value FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey")
def formatted_result(spark, sf):
    region = table(spark, sf, "region").where("r_regionkey != 2")
    rows = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")
    return catalog.formatted(rows, "string")


@book.add("SELECT o_orderkey % 8 AS shard, count(*) AS n FROM orders GROUP BY 1")
def number_routing(spark, sf):
    """Routing by the number itself, the one hash whose values must agree with other systems."""
    return table(spark, sf, "orders").groupBy(F.pmod("o_orderkey", F.lit(8)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def hash_ranges(spark, sf):
    """Two hash ranges of a topic that cover it, each with its mask filter."""
    events = table(spark, sf, "events").withColumn("hash", documents.topic_hash(F.col("user_id"))).withColumn("mask", F.lit(5))
    low = events.where(documents.in_hash_range(F.col("hash"), 0, 32767, F.col("mask"), 4, 4))
    high = events.where(documents.in_hash_range(F.col("hash"), 32768, 65535, F.col("mask"), 1, 1))
    return low.unionByName(high).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@book.add("SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")
def encrypted_feed(spark, sf):
    """Lines of a feed through encrypted blocks and back."""
    return _through_blocks(spark, sf, False)


@book.add("SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")
def encrypted_compressed_feed(spark, sf):
    return _through_blocks(spark, sf, True)


def _through_blocks(spark, sf, compress):
    key, path = "0123456789abcdef", scratch(spark, "secret")
    lines = table(spark, sf, "part").select(scalar.strcat(F.col("p_partkey").cast("string"), "\t", F.col("p_brand"), "/", F.col("p_type")).alias("line"))
    files.write_encrypted(lines, path, "line", key, compress)
    parts = F.split("line", "\t")
    return files.read_encrypted(spark, path, key).select(parts[0].cast("long").alias("p_partkey"), parts[1].alias("label"))


@book.add("SELECT n_nationkey, to_json({n_nationkey: n_nationkey, n_name: n_name, r_name: r_name})::VARCHAR AS value FROM (SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey)")
def json_result(spark, sf):
    region = table(spark, sf, "region").where("r_regionkey != 2")
    rows = table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    return catalog.formatted(rows, "json").select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("n_nationkey"), "value")


@book.add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 1")
def named_table_functions(spark, sf):
    rows = table_functions.call("tableMetricTvf", table(spark, sf, "orders"), "orders")
    rows = table_functions.call("identityTvf", rows)
    return table_functions.call("rankTvf", rows, "o_custkey", "+o_totalprice,+o_orderkey", 1).select("o_custkey", "o_orderkey", "o_totalprice")


@book.add("SELECT count(*) AS n FROM events WHERE epoch(ts) < epoch(now())")
def current_time(spark, sf):
    return table(spark, sf, "events").where(F.unix_timestamp("ts") < scalar.current_time_in_seconds()).agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT p_partkey, p_size FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size > 45")
def layers_by_range(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return tables.layered([(part, F.col("p_size") < 5), (part, F.col("p_size") > 45)])


@book.add("SELECT n_regionkey, n_nationkey, n_name FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 12")
def fixed_fields_feed(spark, sf):
    """A feed in another command format, filtered on reading."""
    path = scratch(spark, "feed")
    files.write_documents(table(spark, sf, "nation"), path, command="update_field")
    found = files.read_documents(spark, path, {"n_regionkey": "int", "n_nationkey": "int", "n_name": "string"})
    return catalog.limited(found.where("CMD = 'update_field'").drop("CMD").orderBy("n_regionkey", "n_nationkey"), 12)


QUERIES, ORACLE = book.queries, book.oracle
