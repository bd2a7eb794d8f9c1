"""Window functions. Partitions are keys with few rows each; global numbering is shown on bounded inputs only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import Registry, Tables

R = Registry()


def by_customer():
    return W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@R.operator("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def win_row_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", F.row_number().over(by_customer()).cast("bigint").alias("rn"))


@R.operator("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DECIMAL(28,2)) AS total FROM orders")
def win_sum_partition(t: Tables) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(W.partitionBy("o_custkey")).cast("decimal(28,2)")
    return t.orders.select("o_orderkey", total.alias("total"))


@R.operator("""
SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 8) AS pr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""")
def win_rank_family(t: Tables) -> DataFrame:
    w = W.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"), F.round(F.percent_rank().over(w), 8).alias("pr"))


@R.operator("""
SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS nt, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS cd FROM part""")
def win_ntile_cume(t: Tables) -> DataFrame:
    w = W.partitionBy("p_brand")
    return t.part.select("p_partkey", F.ntile(4).over(w.orderBy("p_size", "p_partkey")).cast("bigint").alias("nt"), F.round(F.cume_dist().over(w.orderBy("p_size")), 8).alias("cd"))


@R.operator("""
SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_totalprice, 2, -1.0) OVER w AS ahead
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_lag_lead(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(by_customer()).alias("prev"), F.lead("o_totalprice", 2, -1.0).over(by_customer()).alias("ahead"))


@R.operator("""
SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last_nth(t: Tables) -> DataFrame:
    w = by_customer().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("f"), F.last("o_orderkey").over(w).alias("l"), F.nth_value("o_orderkey", 2).over(w).alias("n"))


@R.operator("""
SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(28,2)) AS last3 FROM orders""")
def win_frame_rows(t: Tables) -> DataFrame:
    last3 = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(by_customer().rowsBetween(-2, 0)).cast("decimal(28,2)")
    return t.orders.select("o_orderkey", last3.alias("last3"))


@R.operator("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part")
def win_frame_range(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.count(F.lit(1)).over(W.partitionBy("p_brand").orderBy("p_size").rangeBetween(-2, 2)).alias("near"))


@R.operator("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM part")
def win_frame_groups(t: Tables) -> DataFrame:
    """A frame of peer groups is a range over the dense rank."""
    ranked = t.part.withColumn("g", F.dense_rank().over(W.partitionBy("p_brand").orderBy("p_size")))
    return ranked.select("p_partkey", F.count(F.lit(1)).over(W.partitionBy("p_brand").orderBy("g").rangeBetween(-1, 1)).alias("near"))


@R.operator("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def win_qualify(t: Tables) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.withColumn("rn", rn).where("rn <= 2").select("o_custkey", "o_orderkey")
