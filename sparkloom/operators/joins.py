"""Joins. Physical strategies are left to Catalyst and AQE; only sides of a fixed size are broadcast by hint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import money, total
from .base import Registry, Tables

R = Registry()


@R.operator("""
SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, count(*) AS n_orders
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def join_inner_group(t: Tables) -> DataFrame:
    """Orders are summed by customer before the join, so the shuffle carries a row a customer, not one an order."""
    by_customer = t.orders.groupBy("o_custkey").agg(total(money("o_totalprice")).alias("total"), F.count(F.lit(1)).alias("n"))
    return (
        by_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.sum("total").cast("decimal(28,2)").alias("total"), F.sum("n").alias("n_orders"))
    )


@R.operator("SELECT a.s_nationkey, count(*) AS pairs FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey GROUP BY a.s_nationkey")
def join_self_theta(t: Tables) -> DataFrame:
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    on = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))
    return a.join(b, on).groupBy(F.col("a.s_nationkey").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("pairs"))


@R.operator("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_left_outer(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 400000")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@R.operator("SELECT o_orderkey, c_name FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 9000")
def join_right_outer(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9000")
    return rich.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_name")


@R.operator("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_acctbal < c_acctbal")
def join_full_outer(t: Tables) -> DataFrame:
    on = (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_acctbal") < F.col("c_acctbal"))
    return t.supplier.join(t.customer, on, "full").select("s_suppkey", "c_custkey")


@R.operator("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 300000)")
def join_semi_in(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice >= 300000")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.operator("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti_not_exists(t: Tables) -> DataFrame:
    large = t.orders.where("o_totalprice > 250000")
    return t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def not_in(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of left whose key is NOT IN the other column, with SQL's NULLs: none if it holds one; a NULL key stays only beside no rows.

    Scalar subqueries tell of the NULLs, so the rest is a plain anti join that is dealt by the key.
    """
    rows, nulls = (right.agg(x.alias("n")).scalar() for x in (F.count(F.lit(1)), F.count_if(F.col(other).isNull())))
    kept = left.join(right.where(F.col(other).isNotNull()).select(other), F.col(key) == F.col(other), "left_anti")
    return kept.where((nulls == 0) & (F.col(key).isNotNull() | (rows == 0)))


@R.operator("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_anti_not_in(t: Tables) -> DataFrame:
    return not_in(t.part.select("p_partkey"), "p_partkey", t.lineitem.where("l_quantity > 45").select("l_partkey"), "l_partkey")


@R.operator("""
SELECT 'null among them' AS test, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT nullif(o_orderkey, 7) FROM orders)
UNION ALL SELECT 'null key', count(*) FROM part WHERE nullif(p_partkey, 3) NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'no rows', count(*) FROM part WHERE nullif(p_partkey, 3) NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 0)""")
def join_anti_not_in_null(t: Tables) -> DataFrame:
    keys = t.part.select(F.nullif("p_partkey", F.lit(3)).alias("k"))
    cases = (
        ("null among them", not_in(t.part.select("p_partkey"), "p_partkey", t.orders.select(F.nullif("o_orderkey", F.lit(7)).alias("o")), "o")),
        ("null key", not_in(keys, "k", t.lineitem.where("l_quantity > 45").select("l_partkey"), "l_partkey")),
        ("no rows", not_in(keys, "k", t.lineitem.where("l_quantity < 0").select("l_partkey"), "l_partkey")),
    )
    counts = [df.agg(F.lit(name).alias("test"), F.count(F.lit(1)).alias("n")) for name, df in cases]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@R.operator("SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) n NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region) r")
def join_natural(t: Tables) -> DataFrame:
    n, r = t.nation.selectExpr("n_name", "n_regionkey AS k"), t.region.selectExpr("r_name", "r_regionkey AS k")
    return n.join(F.broadcast(r), [c for c in n.columns if c in r.columns]).select("n_name", "r_name")


@R.operator("SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey AND length(a.n_name) < length(b.r_name)")
def join_theta(t: Tables) -> DataFrame:
    """Nations and regions are 25 and 5 rows at any size."""
    on = (F.col("n_regionkey") > F.col("r_regionkey")) & (F.length("n_name") < F.length("r_name"))
    return t.nation.join(F.broadcast(t.region), on).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))


@R.operator("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    """Both sides have a fixed number of rows."""
    return t.region.crossJoin(F.broadcast(t.nation)).select("r_name", "n_name")


@R.operator("SELECT n_name, n_regionkey, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey)")
def join_using(t: Tables) -> DataFrame:
    return t.nation.join(F.broadcast(t.region.withColumnRenamed("r_regionkey", "n_regionkey")), "n_regionkey").select("n_name", "n_regionkey", "r_name")


@R.operator("""
SELECT c_custkey, l.o_orderkey AS top_order FROM customer, LATERAL (
  SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) l""")
def join_lateral(t: Tables) -> DataFrame:
    """Decorrelated: the best order of each customer is an aggregate, joined once."""
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b")
    top = t.orders.groupBy("o_custkey").agg(best)
    return t.customer.join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", (-F.col("b.k")).alias("top_order"))


@R.operator("""
SELECT n_name, CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND c_nationkey = s_nationkey GROUP BY n_name""")
def join_star_5way(t: Tables) -> DataFrame:
    """Nations of a region are 25 rows at most, so they filter both dimensions before the facts are joined."""
    nations = F.broadcast(t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name"))
    suppliers = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    bought = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    net = (money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    sold = t.lineitem.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = sold.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return rows.groupBy("n_name").agg(F.sum(net).cast("decimal(28,4)").alias("revenue"))
