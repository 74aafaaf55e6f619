"""Ranking and other table-valued functions, and table kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.operators import ranking, tables
from lodestone.session import table

from .base import Book

book = Book()


@book.add("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def rank_tvf(spark, sf):
    return ranking.rank_rows(table(spark, sf, "orders"), ["o_custkey"], "-o_totalprice,+o_orderkey", 2).select("o_custkey", "o_orderkey", "o_totalprice")


@book.add("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) <= 3")
def unordered_rank_tvf(spark, sf):
    return ranking.rank_rows(table(spark, sf, "part"), ["p_brand"], "p_size,p_partkey", 3).select("p_brand", "p_partkey")


@book.add("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def sort_tvf(spark, sf):
    return ranking.sort_rows(table(spark, sf, "lineitem"), "-l_extendedprice,+l_orderkey,+l_linenumber", 25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@book.add("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15")
def top_k_tvf(spark, sf):
    return ranking.sort_rows(table(spark, sf, "customer"), "+c_acctbal,+c_custkey", 15).select("c_custkey", "c_acctbal")


@book.add("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) <= 10 AS \"topKMark\" FROM supplier")
def top_k_mark_tvf(spark, sf):
    return ranking.mark_top(table(spark, sf, "supplier"), "-s_acctbal,+s_suppkey", 10, "s_suppkey").select("s_suppkey", "topKMark")


@book.add(
    "WITH r AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) <= CASE p_size WHEN 10 THEN 5 WHEN 20 THEN 3 WHEN 99 THEN 4 ELSE 0 END AS quota_row, p_retailprice FROM part) "
    "SELECT p_partkey, p_size, quota_row FROM r ORDER BY quota_row DESC, p_retailprice DESC, p_partkey LIMIT 20"
)
def quota_rerank(spark, sf):
    rows = table(spark, sf, "part").withColumn("size", F.col("p_size").cast("string"))
    return ranking.quota_rerank(rows, "size", {"10": 5, "20": 3, "99": 4}, "-p_retailprice,+p_partkey", 20).select("p_partkey", "p_size", "quota_row")


@book.add(
    "WITH q AS (SELECT * FROM (VALUES (10, 6), (20, 4), (99, 7)) t(size, quota)), n AS (SELECT size, quota, (SELECT count(*) FROM part WHERE p_size = size) AS n FROM q), "
    "spare AS (SELECT sum(greatest(quota - n, 0)) AS s FROM n), "
    "r AS (SELECT p_partkey, p_size, p_retailprice, quota, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) AS k FROM part JOIN q ON p_size = size), "
    "x AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS e FROM r WHERE k > quota) "
    "SELECT p_partkey, p_size FROM r WHERE k <= quota UNION ALL SELECT p_partkey, p_size FROM x, spare WHERE e <= s"
)
def spare_quota_rerank(spark, sf):
    rows = table(spark, sf, "part")
    return ranking.spare_quota_rerank(rows, "p_size", {10: 6, 20: 4, 99: 7}, "-p_retailprice,+p_partkey").select("p_partkey", "p_size")


@book.add(
    "WITH t AS (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60), "
    "d AS (SELECT *, (row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice DESC, p_partkey) - 1) // 2 AS turn FROM t), "
    "p AS (SELECT *, row_number() OVER (ORDER BY turn, p_retailprice DESC, p_partkey) AS place FROM d) SELECT p_partkey, place, (place - 1) // 10 AS \"window\" FROM p"
)
def window_rerank(spark, sf):
    return ranking.window_rerank(table(spark, sf, "part"), "p_size", "-p_retailprice,+p_partkey", 10, 2, 60).select("p_partkey", "place", "window")


@book.add("SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS part FROM nation")
def unpack_multi_value(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.split("n_name", "A").alias("part"))
    return tables.unpack_multi_value(rows, "part")


@book.add(
    "SELECT p_partkey, CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, 1, strpos(p_type, ' ') - 1) ELSE p_type END AS trans_cola, "
    "CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, strpos(p_type, ' ') + 1) ELSE '' END AS trans_colb FROM part"
)
def trans_rows(spark, sf):
    return tables.trans_rows(table(spark, sf, "part"), "p_type", " ").select("p_partkey", "trans_cola", "trans_colb")


@book.add("SELECT * FROM (VALUES (1, 'huawei', [4599, 3999]), (2, 'xiaomi', [2999]), (3, 'oppo', [3799, 1, 2])) t(nid, brand, prices)")
def input_table(spark, sf):
    return tables.input_table(spark, "1,huawei,4599:3999;2,xiaomi,2999;3,oppo,3799:1:2", "nid int, brand string, prices array<int>")


_LAYERS = (
    "SELECT o_orderkey, 'hot' AS layer, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'cold', o_totalprice + 1 FROM orders WHERE o_orderkey % 2 = 0"
)


@book.add(f"SELECT * FROM ({_LAYERS}) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY layer DESC) = 1")
def layer_table(spark, sf):
    orders = table(spark, sf, "orders")
    hot = orders.select("o_orderkey", F.lit("hot").alias("layer"), "o_totalprice")
    cold = orders.select("o_orderkey", F.lit("cold").alias("layer"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return tables.layered([(hot, F.col("o_orderkey") % 3 == 0), (cold, F.col("o_orderkey") % 2 == 0)], "o_orderkey", [F.desc("layer")])


@book.add("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey IN (3, 14, 15, 92)")
def key_value_lookup(spark, sf):
    return tables.key_lookup(table(spark, sf, "supplier"), "s_suppkey", [3, 14, 15, 92]).select("s_suppkey", "s_name", "s_acctbal")


@book.add("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (1, 2, 5, 8) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4")
def prefix_key_lookup(spark, sf):
    return tables.prefix_lookup(table(spark, sf, "orders"), "o_custkey", [1, 2, 5, 8], "o_orderkey", 4).select("o_custkey", "o_orderkey")


@book.add("SELECT doc_id, source, n_chars, lang FROM documents WHERE doc_id IN (7, 77, 777)")
def summary_lookup(spark, sf):
    return tables.key_lookup(table(spark, sf, "documents"), "doc_id", [7, 77, 777]).select("doc_id", "source", "n_chars", "lang")


@book.add("SELECT o_orderkey, o_custkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def unnest_outer(spark, sf):
    return tables.unnest(_orders_with_lines(spark, sf), "lines", outer=True).select("o_orderkey", "o_custkey", "l_linenumber", "l_quantity")


@book.add("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25")
def unnest_filtered(spark, sf):
    return tables.unnest(_orders_with_lines(spark, sf), "lines").where("l_quantity > 25").select("o_orderkey", "l_linenumber")


def _orders_with_lines(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_returnflag")
    return tables.nested(orders, lines, "o_orderkey", "lines", ["l_linenumber", "l_quantity"])


@book.add(
    "SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(l_quantity) AS total, min(l_quantity) AS least, max(l_quantity) AS most, "
    "arg_min(l_quantity, (l_linenumber, l_quantity)) AS first, string_agg(l_returnflag, '+' ORDER BY l_linenumber, l_quantity, l_returnflag) AS flags FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1"
)
def sub_functions(spark, sf):
    lines = F.col("lines")
    return _orders_with_lines(spark, sf).where("lines is not null").select(
        "o_orderkey",
        scalar.sub_count(lines).cast("long").alias("n"),
        scalar.sub_sum(lines, lambda c: c["l_quantity"]).alias("total"),
        scalar.sub_min(lines, lambda c: c["l_quantity"]).alias("least"),
        scalar.sub_max(lines, lambda c: c["l_quantity"]).alias("most"),
        scalar.sub_first(lines, lambda c: c["l_quantity"]).alias("first"),
        scalar.sub_join(lines, lambda c: c["l_returnflag"], "+").alias("flags"),
    )


@book.add("SELECT l_suppkey, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity FROM lineitem WHERE l_suppkey = 42 AND l_returnflag = 'R' GROUP BY l_suppkey")
def aggregation_index(spark, sf):
    measures = {"n": F.count(F.lit(1)), "quantity": F.sum(F.col("l_quantity").cast("decimal(18,2)"))}
    index = tables.AggregationTable(table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], measures)
    return index.answer({"l_suppkey": 42, "l_returnflag": "R"}, needed=["l_suppkey", "n", "quantity"])


QUERIES, ORACLE = book.queries, book.oracle
