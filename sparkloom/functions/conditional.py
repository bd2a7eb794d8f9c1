"""Conditional functions and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import Registry, Tables

R = Registry()


@R.operator("""
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS a, ifnull(nullif(o_orderstatus, 'O'), 'open') AS b, CASE WHEN nullif(o_orderstatus, 'P') IS NOT NULL THEN 1 ELSE 0 END AS c,
       greatest(o_custkey, o_orderkey) AS g, least(o_custkey, o_orderkey) AS l FROM orders""")
def fn_conditional(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", F.coalesce(F.nullif(status, F.lit("F")), F.lit("done")).alias("a"), F.ifnull(F.nullif(status, F.lit("O")), F.lit("open")).alias("b"), F.nvl2(F.nullif(status, F.lit("P")), F.lit(1), F.lit(0)).alias("c"),
        F.greatest("o_custkey", "o_orderkey").alias("g"), F.least("o_custkey", "o_orderkey").alias("l"),
    )


@R.operator("""
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS d, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderdate AS DATE) AS dt, TRY_CAST(o_orderpriority AS INTEGER) AS bad, CAST('42' AS INTEGER) AS i,
       CAST(o_orderkey % 2 AS BOOLEAN) AS b, CAST(o_custkey AS DOUBLE) AS f FROM orders""")
def fn_cast(t: Tables) -> DataFrame:
    c = F.col
    return t.orders.select(
        "o_orderkey", c("o_totalprice").cast("decimal(12,2)").alias("d"), c("o_orderkey").cast("string").alias("s"), c("o_orderdate").cast("date").alias("dt"), c("o_orderpriority").try_cast("int").alias("bad"),
        F.lit("42").cast("int").alias("i"), (c("o_orderkey") % 2).cast("boolean").alias("b"), c("o_custkey").cast("double").alias("f"),
    )
