"""Joins of every kind that the dialect has."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import joins
from lodestone.session import table

from .base import Book

book = Book()


@book.add("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40 WHERE o_orderstatus = 'O'")
def inner_join_residual(spark, sf):
    orders, items = table(spark, sf, "orders").where("o_orderstatus = 'O'"), table(spark, sf, "lineitem")
    return joins.equi_join(orders, items, [("o_orderkey", "l_orderkey")], "inner", items["l_quantity"] > 40).select("o_orderkey", "l_linenumber", "l_quantity")


@book.add("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
def left_join(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000")
    return joins.equi_join(table(spark, sf, "customer"), big, [("c_custkey", "o_custkey")], "left").select("c_custkey", "o_orderkey")


@book.add("SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey AND n_regionkey = 1")
def right_join(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return joins.equi_join(nation, supplier, [("n_nationkey", "s_nationkey")], "right", nation["n_regionkey"] == 1).select("s_suppkey", "n_name")


@book.add(
    "SELECT c_custkey, CASE WHEN k IS NULL THEN 'none' ELSE status END AS status, CASE WHEN k IS NULL THEN -1 ELSE o_totalprice END AS price "
    "FROM customer LEFT JOIN (SELECT o_custkey AS k, nullif(o_orderstatus, 'F') AS status, o_totalprice FROM orders WHERE o_totalprice > 300000) ON c_custkey = k"
)
def left_join_defaults(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 300000")
    big = big.select(F.col("o_custkey").alias("c_custkey"), F.expr("nullif(o_orderstatus, 'F')").alias("status"), F.col("o_totalprice").alias("price"))
    joined = joins.left_join_with_defaults(table(spark, sf, "customer").select("c_custkey"), big, "c_custkey", {"status": "none", "price": -1.0})
    return joined.select("c_custkey", "status", "price")


@book.add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf):
    customer, big = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 300000")
    return joins.equi_join(customer, big, [("c_custkey", "o_custkey")], "left_semi").select("c_custkey", "c_name")


@book.add("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, sf):
    customer, big = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_totalprice > 300000")
    return joins.equi_join(customer, big, [("c_custkey", "o_custkey")], "left_anti").select("c_custkey", "c_name")


_NOT_IN = "SELECT p_partkey FROM {part} WHERE p_size NOT IN (SELECT CAST(s_suppkey AS INT) FROM {supplier} WHERE s_suppkey < 40)"


@book.add(_NOT_IN.format(part="part", supplier="supplier"))
def not_in_subquery(spark, sf):
    few = table(spark, sf, "supplier").where("s_suppkey < 40").select(F.col("s_suppkey").cast("int").alias("size"))
    return joins.not_in(table(spark, sf, "part"), "p_size", few, "size").select("p_partkey")


@book.add("SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT CASE WHEN n_nationkey = 3 THEN NULL ELSE n_regionkey END FROM nation)")
def not_in_with_a_null(spark, sf):
    values = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_regionkey")).alias("v"))
    return joins.not_in(table(spark, sf, "region"), "r_regionkey", values, "v").select("r_regionkey")


@book.add("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < 2 AND n_regionkey >= 3")
def cross_join(spark, sf):
    return table(spark, sf, "region").where("r_regionkey < 2").crossJoin(table(spark, sf, "nation").where("n_regionkey >= 3")).select("r_name", "n_name")


@book.add("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("low"), F.col("n_regionkey").alias("r"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("high"), F.col("n_regionkey").alias("s"))
    return a.join(b, (F.col("r") == F.col("s")) & (F.col("low") < F.col("high"))).select("low", "high")


@book.add("SELECT l_orderkey, l_linenumber, p_name FROM (SELECT * FROM lineitem WHERE l_quantity = 50) JOIN part ON l_partkey = p_partkey")
def lookup_join(spark, sf):
    probe = table(spark, sf, "lineitem").where("l_quantity = 50").withColumnRenamed("l_partkey", "p_partkey")
    return joins.lookup_join(probe, table(spark, sf, "part"), "p_partkey").select("l_orderkey", "l_linenumber", "p_name")


@book.add("SELECT o_orderkey, s_suppkey FROM (SELECT o_orderkey, [o_custkey % 100, o_orderkey % 100, 7] AS m FROM orders) JOIN supplier ON list_contains(m, s_suppkey)")
def multicast_join(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 100, F.col("o_orderkey") % 100, F.lit(7).cast("long")).alias("m"))
    return joins.multicast_join(rows, "m", table(spark, sf, "supplier"), "s_suppkey").select("o_orderkey", "s_suppkey")


@book.add(
    "WITH o AS (SELECT o_orderkey, [o_custkey % 150, o_orderkey % 150] AS m FROM orders), "
    "e AS (SELECT o_orderkey, m, unnest(m) AS k, generate_subscripts(m, 1) AS pos FROM o) "
    "SELECT o_orderkey, list(s_name ORDER BY pos) AS names FROM e LEFT JOIN supplier ON k = s_suppkey GROUP BY o_orderkey"
)
def left_multi_join(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_custkey") % 150, F.col("o_orderkey") % 150).alias("m"))
    return joins.left_multi_join(rows, "o_orderkey", "m", table(spark, sf, "supplier"), "s_suppkey", "s_name", "names").select("o_orderkey", "names")


@book.add("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def main_aux_view(spark, sf):
    nation = table(spark, sf, "nation")
    return joins.equi_join(table(spark, sf, "customer"), nation, [("c_nationkey", "n_nationkey")], "left").select("c_custkey", "c_name", "n_name")


@book.add("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice >= abs(s_acctbal) AND p_retailprice < abs(s_acctbal) + 25")
def range_join(spark, sf):
    bands = table(spark, sf, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("low"), (F.abs("s_acctbal") + 25).alias("high"))
    return joins.range_join(table(spark, sf, "part"), bands, "p_retailprice", "low", "high", 25.0).select("p_partkey", "s_suppkey")


QUERIES, ORACLE = book.queries, book.oracle
