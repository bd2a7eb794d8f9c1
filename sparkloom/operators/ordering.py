"""Sorts, limits and top-k. NULL placement is always explicit, since engines differ in their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import work_folder
from .base import Registry, Tables

R = Registry()


def ranked(df: DataFrame, *order, name: str = "place") -> DataFrame:
    """df in order, with each row's place, so that a comparison of sets compares the order as well."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """An ordered frame of any size with each row's place: its place in its range partition after the rows of those before.

    The sorted rows are written once, so that both passes see the same partitions; no task holds more than one of them.
    """
    spark, path = ordered.sparkSession, work_folder(ordered.sparkSession, "numbered")
    marked = ordered.withColumn("_at", F.monotonically_increasing_id())
    marked.write.parquet(path)
    held, partition, before, rows = spark.read.schema(marked.schema).parquet(path), F.shiftright("_at", 33), [], 0
    for r in held.groupBy(partition.alias("p")).count().orderBy("p").collect():
        before.append((r["p"], rows))
        rows += r["count"]
    starts = F.broadcast(spark.createDataFrame(before, "_partition long, _before long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return held.join(starts, partition == F.col("_partition")).select(*ordered.columns, place.alias(name))


@R.operator("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def limit_topk(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20)


@R.operator("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 100")
def limit_offset(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(100).limit(30)


@R.operator("SELECT n_name, row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS place FROM nation")
def order_places(t: Tables) -> DataFrame:
    return ranked(t.nation, F.desc("n_regionkey"), "n_name").select("n_name", "place")


@R.operator("SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey) AS place FROM customer")
def order_multi_key(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return numbered(rows.orderBy(F.asc_nulls_last("c_mktsegment"), F.desc_nulls_first("c_acctbal"), "c_custkey"))


@R.operator("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, row_number() OVER (ORDER BY nullif(o_orderstatus, 'P') ASC NULLS FIRST, o_orderkey) AS place FROM orders")
def order_nulls_first(t: Tables) -> DataFrame:
    return numbered(t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s")).orderBy(F.asc_nulls_first("s"), "o_orderkey"))


@R.operator("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) AS place FROM orders")
def order_nulls_last(t: Tables) -> DataFrame:
    return numbered(t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s")).orderBy(F.desc_nulls_last("s"), "o_orderkey"))
