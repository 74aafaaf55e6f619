"""Projection, filters, aggregation, set operations, sorting and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.session import table

from .base import Book

book = Book()


@book.add("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity >= 45 AND l_discount > 0.05 AND NOT (l_returnflag = 'R')")
def filter_project(spark, sf):
    rows = table(spark, sf, "lineitem").where((F.col("l_quantity") >= 45) & (F.col("l_discount") > 0.05) & ~(F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@book.add("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 7) AND n_regionkey NOT IN (2, 4)")
def in_and_not_in(spark, sf):
    rows = table(spark, sf, "nation")
    return rows.where(F.col("n_nationkey").isin(1, 3, 5, 7) & ~F.col("n_regionkey").isin(2, 4)).select("n_nationkey", "n_name")


@book.add("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class FROM part")
def case_when(spark, sf):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return table(spark, sf, "part").select("p_partkey", size.alias("size_class"))


@book.add("SELECT event_id, CAST(user_id AS VARCHAR) AS user_text, TRY_CAST(event_type AS BIGINT) AS number, CAST(floor(value) AS BIGINT) AS whole FROM events")
def casts(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").cast("string").alias("user_text"), F.col("event_type").try_cast("long").alias("number"), F.floor("value").cast("long").alias("whole")
    )


@book.add("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_acctbal > 1000.5")
def bound_parameters(spark, sf):
    return spark.sql(
        "SELECT c_custkey, c_name FROM {customer} WHERE c_nationkey = :nation AND c_acctbal > :least", args={"nation": 7, "least": 1000.5}, customer=table(spark, sf, "customer")
    )


@book.add(
    "SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS sum_qty, min(l_extendedprice) AS least, max(l_extendedprice) AS most, "
    "count(*) AS n, round(avg(l_discount), 6) AS mean_discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"
)
def group_by_aggregates(spark, sf):
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("sum_qty"),
        F.min("l_extendedprice").alias("least"),
        F.max("l_extendedprice").alias("most"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("l_discount"), 6).alias("mean_discount"),
    )


@book.add("SELECT count(*) AS n, sum(o_orderkey) AS keys, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
def global_aggregate(spark, sf):
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@book.add("SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1 HAVING count(*) > 12")
def filtered_aggregate_having(spark, sf):
    grouped = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("finished"))
    return grouped.where("n > 12")


@book.add("SELECT event_type, min(user_id) AS any_user, max(length(props)) AS longest FROM events GROUP BY 1")
def arbitrary_value(spark, sf):
    # any value would do; the least makes the result the same each time
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("user_id").alias("any_user"), F.max(F.length("props")).alias("longest"))


@book.add("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, sf):
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {t} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", t=table(spark, sf, "lineitem"))


@book.add("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_rows(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


@book.add("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def distinct_aggregate(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))


@book.add(
    "SELECT event_type, count(DISTINCT user_id) AS exact, true AS close FROM events GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT user_id), true FROM events"
)
def approximate_distinct(spark, sf):
    """Sketches by group, and merged over all groups; ``close`` tells that an estimate is within a twentieth of the count."""
    events = table(spark, sf, "events")
    groups = events.groupBy("event_type").agg(F.hll_sketch_agg("user_id", 12).alias("sketch"))
    merged = groups.agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit("all").alias("event_type"), "sketch")
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    exact = exact.unionByName(events.agg(F.countDistinct("user_id").alias("exact")).withColumn("event_type", F.lit("all")))
    both = groups.unionByName(merged).join(exact, "event_type")
    return both.select("event_type", "exact", (F.abs(F.hll_sketch_estimate("sketch") - F.col("exact")) <= F.col("exact") / 20).alias("close"))


@book.add(
    "SELECT o_orderkey, count(*) OVER w AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS running, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS highest "
    "FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
)
def over_aggregates(spark, sf):
    own = Window.partitionBy("o_custkey")
    so_far = own.orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.count(F.lit(1)).over(so_far).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(so_far).alias("running"), F.max("o_orderpriority").over(own).alias("highest")
    )


_MIXED = "SELECT c_nationkey AS nation FROM {customer} WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM {supplier} UNION ALL SELECT n_nationkey FROM {nation}"


@book.add(_MIXED.format(customer="customer", supplier="supplier", nation="nation"))
def union_mixed(spark, sf):
    return spark.sql(_MIXED, customer=table(spark, sf, "customer"), supplier=table(spark, sf, "supplier"), nation=table(spark, sf, "nation"))


@book.add("SELECT c_custkey AS id, 'customer' AS kind FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_acctbal < 0")
def union_all(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    b = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return a.unionByName(b)


@book.add("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


CTE = """WITH big (custkey, n, spent) AS (SELECT o_custkey, count(*), sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM {orders} GROUP BY o_custkey)
SELECT c_nationkey, count(*) AS customers, max(n) AS most_orders, sum(spent) AS spent FROM {customer} JOIN big ON c_custkey = custkey WHERE n >= 5 GROUP BY c_nationkey"""


@book.add(CTE.format(orders="orders", customer="customer"))
def common_table_expression(spark, sf):
    return spark.sql(CTE, orders=table(spark, sf, "orders"), customer=table(spark, sf, "customer"))


@book.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def order_limit_offset(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@book.add(
    "SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS label, event_id + user_id * 2 AS summed, round(pow(value, 2), 4) AS squared, "
    "CASE WHEN value > 0 THEN round(ln(value) / ln(2), 6) END AS log2_value FROM events"
)
def scalar_functions(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        scalar.strcat(F.col("event_type"), ":", F.col("user_id").cast("string")).alias("label"),
        scalar.sum_of(F.col("event_id"), F.col("user_id") * 2).alias("summed"),
        F.round(F.pow("value", F.lit(2)), 4).alias("squared"),
        F.when(F.col("value") > 0, F.round(scalar.log_of(F.lit(2.0), F.col("value")), 6)).alias("log2_value"),
    )


@book.add("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F', 'P')")
def string_membership(spark, sf):
    return table(spark, sf, "orders").where(scalar.in_string(F.col("o_orderpriority"), "1-URGENT,2-HIGH") & scalar.notin_string(F.col("o_orderstatus"), "F;P", ";")).select("o_orderkey", "o_orderpriority")


@book.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'")
def json_field(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@book.add("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def time_series(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@book.add("SELECT event_type AS tag, count(*) AS points, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def series_meta(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("points"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@book.add("SELECT n_nationkey, n_name FROM nation WHERE false")
def empty_relation(spark, sf):
    return spark.createDataFrame([], "n_nationkey int, n_name string")


QUERIES, ORACLE = book.queries, book.oracle
