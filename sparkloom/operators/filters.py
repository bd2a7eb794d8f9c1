"""Projections, filters and predicates; all of them reach the Parquet scan as far as the source allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Registry, Tables

R = Registry()


@R.operator("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")


@R.operator("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def filter_range_between(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@R.operator("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 OR (l_quantity >= 49 AND l_discount <= 0.01) OR l_tax > 0.079")
def filter_comparisons(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.where((c("l_quantity") < 3) | ((c("l_quantity") >= 49) & (c("l_discount") <= 0.01)) | (c("l_tax") > 0.079)).select("l_orderkey", "l_linenumber")


@R.operator("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (1, 5, 8, 13, 21, 34, 55, 89)")
def filter_in_list(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_custkey").isin(1, 5, 8, 13, 21, 34, 55, 89)).select("o_orderkey", "o_orderpriority")


@R.operator("SELECT p_partkey, p_brand, p_size FROM part WHERE (p_size = 1 OR p_size = 50) AND p_retailprice > 950")
def filter_or_and(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.where(((size == 1) | (size == 50)) & (F.col("p_retailprice") > 950)).select("p_partkey", "p_brand", "p_size")


@R.operator("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'b%g'")
def filter_ilike(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").ilike("b%g")).select("c_custkey", "c_mktsegment")


@R.operator("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '%1'")
def filter_like(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_type").like("%A%") & ~F.col("p_name").like("%1")).select("p_partkey", "p_type")


@R.operator("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[13579]$')")
def filter_regex(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_name").rlike("[13579]$")).select("c_custkey", "c_name")


@R.operator("""
SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NULL AS was_open, nullif(o_orderstatus, 'O') IS DISTINCT FROM nullif(o_orderstatus, 'F') AS differs
FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL""")
def filter_null_logic(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    a, b, c = (F.nullif(status, F.lit(x)) for x in "OFP")
    return t.orders.where(c.isNotNull()).select("o_orderkey", a.isNull().alias("was_open"), (~a.eqNullSafe(b)).alias("differs"))


@R.operator("SELECT event_id, event_type || ':' || CAST(user_id AS VARCHAR) AS tag FROM events")
def project_concat(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("tag"))


@R.operator("""
SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS class,
       coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority FROM orders""")
def project_case_coalesce(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    size = F.when(price > 200000, "large").when(price > 50000, "medium").otherwise("small")
    return t.orders.select("o_orderkey", size.alias("class"), F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("priority"))


@R.operator("""
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS net
FROM lineitem""")
def project_arithmetic(t: Tables) -> DataFrame:
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return t.lineitem.select("l_orderkey", "l_linenumber", net.cast("decimal(18,4)").alias("net"))


@R.operator("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(id, name)")
def values_rows(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, NULL) AS v(id, name)")


@R.operator("SELECT count(*) AS n FROM lineitem")
def count_star(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))
