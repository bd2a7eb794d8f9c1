"""Set operations, common table expressions and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Registry, Tables

R = Registry()


def keys(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


@R.operator("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    a, b = keys(t)
    return a.unionAll(b)


@R.operator("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t: Tables) -> DataFrame:
    a, b = keys(t)
    return a.union(b).distinct()


@R.operator("SELECT c_nationkey AS k FROM customer WHERE c_nationkey < 12 INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 6")
def intersect(t: Tables) -> DataFrame:
    a, b = keys(t)
    return a.where("k < 12").intersect(b.where("k > 6"))


@R.operator("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 6")
def except_distinct(t: Tables) -> DataFrame:
    a, b = keys(t)
    return a.subtract(b.where("k > 6"))


@R.operator("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t: Tables) -> DataFrame:
    a, b = keys(t)
    return a.intersectAll(b)


@R.operator("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t: Tables) -> DataFrame:
    a, b = keys(t)
    return a.exceptAll(b)


@R.operator("""
WITH spent AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders GROUP BY o_custkey)
SELECT o_custkey, total FROM spent WHERE total > 2000000""")
def cte_simple(t: Tables) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))
    return spent.where("total > 2000000")


@R.operator("WITH RECURSIVE s(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 15) SELECT n, f FROM s")
def cte_recursive(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE s(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM s WHERE n < 15) SELECT n, f FROM s")


@R.operator("SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) + 150 FROM part q WHERE q.p_brand = p.p_brand)")
def subquery_scalar_correlated(t: Tables) -> DataFrame:
    """Decorrelated: one mean a brand, joined back."""
    means = t.part.groupBy("p_brand").agg((F.avg("p_retailprice") + 150).alias("m"))
    return t.part.join(means, "p_brand").where("p_retailprice > m").select("p_partkey")


@R.operator("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
def subquery_exists(t: Tables) -> DataFrame:
    full = t.lineitem.where("l_quantity >= 50")
    return t.supplier.join(full, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@R.operator("SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def subquery_scalar(t: Tables) -> DataFrame:
    top = t.orders.agg(F.max("o_totalprice").alias("top"))
    return t.orders.join(F.broadcast(top), F.col("o_totalprice") == F.col("top")).select("o_orderkey")  # an aggregate of one row
