"""Relational queries over the star schema: joins, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import filters, logs
from tessera.plans.registry import query
from tessera.runtime import table

MONEY = "CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE)"


def _revenue():
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)


@query("pricing_summary", f"SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, {MONEY} AS revenue, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").filter("l_shipdate <= DATE '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), _revenue().alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("join_inner_star", f"SELECT n_name, {MONEY} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_inner_star(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(_revenue().alias("revenue"))


@query("join_left_outer", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def join_left_outer(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 300000")
    return table(spark, d, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_full_outer", "SELECT coalesce(c_nationkey, s_nationkey) AS nation, CAST(coalesce(nc, 0) AS BIGINT) AS customers, CAST(coalesce(ns, 0) AS BIGINT) AS suppliers FROM (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def join_full_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("nc"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("ns"))
    joined = c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full_outer")
    return joined.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), F.coalesce("nc", F.lit(0)).alias("customers"), F.coalesce("ns", F.lit(0)).alias("suppliers"))


@query("join_theta", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("low"), F.col("b.n_name").alias("high"))


GROUPED = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INTEGER) AS g1, CAST(grouping(l_linestatus) AS INTEGER) AS g2, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY "


def _grouped(rows) -> DataFrame:
    return rows.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"))


@query("cube", GROUPED + "CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus"))


@query("rollup", GROUPED + "ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query("grouping_sets", GROUPED + "GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(table(spark, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus"))


@query("window_rank_lag", "SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS nth, lag(o_orderkey) OVER w AS before, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_rank_lag(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("nth"), F.lag("o_orderkey").over(w).alias("before"), F.ntile(4).over(w).alias("quarter"))


@query("window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last4, round(max(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS so_far FROM events")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-3, 0)), 4).alias("last4"), F.round(F.max("value").over(w), 4).alias("so_far"))


@query("set_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    of = lambda s: o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").intersect(of("P"))


@query("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey").distinct())


@query("pivot_status", "SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY 1")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query("distinct_json_key", "SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events")
def distinct_json_key(spark: SparkSession, d: str) -> DataFrame:
    return logs.distinct_key(table(spark, d, "events"), "props", "$.k").select(F.col("value").alias("k"))


@query(
    "paired_sample",
    """
WITH r AS (SELECT DISTINCT doc_id % 20 AS query_id, doc_id FROM labels WHERE quality = 1),
s AS (SELECT doc_id FROM documents ORDER BY md5('44:' || doc_id), doc_id LIMIT 100)
SELECT query_id, doc_id, true AS relevant FROM r
UNION ALL SELECT q.query_id, s.doc_id, false FROM (SELECT DISTINCT query_id FROM r) q, s WHERE (q.query_id, s.doc_id) NOT IN (SELECT query_id, doc_id FROM r)
""",
)
def paired_sample(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their relevant documents and a repeatable sample of 100 others."""
    relevant = table(spark, d, "labels").filter("quality = 1").select((F.col("doc_id") % 20).alias("query_id"), "doc_id")
    return filters.paired_sample(relevant, table(spark, d, "documents"), 100, 44)
