"""Aggregations. Sums of money are decimal, so they do not depend on the order in which partial sums meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Registry, Tables

R = Registry()


def money(col: str) -> Column:
    return F.col(col).cast("decimal(18,2)")


def total(col: Column) -> Column:
    return F.sum(col).cast("decimal(28,2)")


@R.operator("""
SELECT CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 6) AS mean, min(p_size) AS lo, max(p_size) AS hi, count(*) AS n FROM part""")
def agg_scalar(t: Tables) -> DataFrame:
    return t.part.agg(
        F.sum("p_size").alias("total"), F.round(F.avg("p_size"), 6).alias("mean"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.count(F.lit(1)).alias("n")
    )


@R.operator("SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, min(p_size) AS lo, max(p_name) AS hi, avg(p_size) AS mean FROM part WHERE p_size < 0")
def agg_empty_input(t: Tables) -> DataFrame:
    return t.part.where("p_size < 0").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"), F.min("p_size").alias("lo"), F.max("p_name").alias("hi"), F.avg("p_size").alias("mean")
    )


@R.operator("SELECT count(*) AS n_all, count(nullif(o_orderstatus, 'F')) AS n_some FROM orders")
def agg_count_null_skip(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.nullif("o_orderstatus", F.lit("F"))).alias("n_some"))


@R.operator("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderpriority").alias("priorities"))


@R.operator("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_values(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_size").distinct()


@R.operator("""
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey""")
def distinct_on(t: Tables) -> DataFrame:
    """The first row of each key in an order: an aggregate with partial results, so no key's rows are gathered."""
    first = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    return t.orders.groupBy("o_custkey").agg(first.alias("f")).select("o_custkey", (-F.col("f.k")).alias("o_orderkey"), F.col("f.o_totalprice"))


@R.operator("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_base,
       CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS sum_disc,
       round(avg(CAST(l_quantity AS DOUBLE)), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def groupby_multi_agg(t: Tables) -> DataFrame:
    net = (money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            total(money("l_quantity")).alias("sum_qty"),
            total(money("l_extendedprice")).alias("sum_base"),
            F.sum(net).cast("decimal(28,4)").alias("sum_disc"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
            F.count(F.lit(1)).alias("n"),
        )
    )


@R.operator("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def groupby_having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 15")


@R.operator("""
SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS g, count(*) AS n FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def grouping_sets(t: Tables) -> DataFrame:
    c = [F.col("l_returnflag"), F.col("l_linestatus")]
    return t.lineitem.groupingSets([[c[0]], [c[1]], []], *c).agg(F.grouping("l_returnflag").alias("g"), F.count(F.lit(1)).alias("n"))


@R.operator("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup(t: Tables) -> DataFrame:
    return t.customer.rollup("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@R.operator("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@R.operator("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'O') AS DECIMAL(28,2)) AS open_total
FROM orders GROUP BY o_orderpriority""")
def agg_filter_clause(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(status == "F").alias("done"), total(F.when(status == "O", money("o_totalprice"))).alias("open_total"))


@R.operator("""
SELECT p_brand, round(stddev_samp(p_size), 6) AS sd, round(stddev_pop(p_size), 6) AS sdp, round(var_samp(p_size), 6) AS v, round(var_pop(p_size), 6) AS vp,
       round(covar_samp(p_size, p_retailprice), 4) AS cs, round(covar_pop(p_size, p_retailprice), 4) AS cp, round(corr(p_size, p_retailprice), 6) AS r
FROM part GROUP BY p_brand""")
def agg_stats(t: Tables) -> DataFrame:
    size, pair = F.col("p_size").cast("double"), (F.col("p_size").cast("double"), F.col("p_retailprice"))
    return t.part.groupBy("p_brand").agg(
        F.round(F.stddev_samp(size), 6).alias("sd"), F.round(F.stddev_pop(size), 6).alias("sdp"),
        F.round(F.var_samp(size), 6).alias("v"), F.round(F.var_pop(size), 6).alias("vp"),
        F.round(F.covar_samp(*pair), 4).alias("cs"), F.round(F.covar_pop(*pair), 4).alias("cp"), F.round(F.corr(*pair), 6).alias("r"),
    )


@R.operator("""
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icpt, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay FROM lineitem""")
def agg_regression(t: Tables) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.agg(
        F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("icpt"), F.regr_count(y, x).alias("n"),
        F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.regr_avgx(y, x), 4).alias("ax"), F.round(F.regr_avgy(y, x), 3).alias("ay"),
    )


@R.operator("""
SELECT p_brand, bool_and(p_size > 0) AS all_pos, bool_or(p_size = 50) AS any_50, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx
FROM part GROUP BY p_brand""")
def agg_bool_bit(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.groupBy("p_brand").agg(
        F.bool_and(size > 0).alias("all_pos"), F.bool_or(size == 50).alias("any_50"), F.bit_and(size).alias("ba"), F.bit_or(size).alias("bo"), F.bit_xor(size).alias("bx")
    )


@R.operator("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders GROUP BY o_orderstatus")
def agg_decimal_sum(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(total(money("o_totalprice")).alias("total"))


@R.operator("SELECT l_returnflag, median(l_quantity) AS med, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg_percentiles(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.median("l_quantity").alias("med"), F.percentile("l_quantity", 0.9).alias("p90"))


@R.operator("""
SELECT n_regionkey, list_sort(list(n_name)) AS names, string_agg(n_name, ',' ORDER BY n_name) AS joined, min(n_name) AS first_name, max(n_name) AS last_name
FROM nation GROUP BY n_regionkey""")
def agg_collect(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list("n_name")).alias("names"), F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("joined"),
        F.min("n_name").alias("first_name"), F.max("n_name").alias("last_name"),
    )


@R.operator("SELECT count(DISTINCT o_custkey) AS exact, true AS near FROM orders")
def agg_approx_distinct(t: Tables) -> DataFrame:
    """A sketch is checked by its bound: three standard errors of two hundredths."""
    both = t.orders.agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("e"))
    return both.select(F.col("e").alias("exact"), (F.abs(F.col("a") - F.col("e")) <= 0.06 * F.col("e")).alias("near"))


@R.operator("SELECT l_returnflag, median(l_extendedprice) AS exact, true AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_percentile(t: Tables) -> DataFrame:
    got = t.lineitem.groupBy("l_returnflag").agg(F.approx_percentile("l_extendedprice", 0.5, 10000).alias("a"), F.median("l_extendedprice").alias("e"))
    return got.select("l_returnflag", F.col("e").alias("exact"), (F.abs(F.col("a") - F.col("e")) <= 0.01 * F.col("e")).alias("near"))


@R.operator("""
SELECT l_returnflag, round(regr_sxx(l_extendedprice, l_quantity), 0) AS xx, round(regr_syy(l_quantity, l_quantity), 0) AS yy, round(regr_sxy(l_quantity, l_quantity), 0) AS xy
FROM lineitem GROUP BY l_returnflag""")
def agg_regression_sums(t: Tables) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.regr_sxx(y, x), 0).alias("xx"), F.round(F.regr_syy(x, x), 0).alias("yy"), F.round(F.regr_sxy(x, x), 0).alias("xy")
    )


@R.operator("""
SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_key, arg_max(o_totalprice, o_orderkey) AS last_price, CAST(count_if(o_totalprice > 100000) AS BIGINT) AS large
FROM orders GROUP BY o_custkey""")
def agg_first_last(t: Tables) -> DataFrame:
    """The first and last value in an order: aggregates with partial results."""
    return t.orders.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", "o_orderkey").alias("first_key"), F.max_by("o_totalprice", "o_orderkey").alias("last_price"),
        F.count_if(F.col("o_totalprice") > 100000).alias("large"),
    )


@R.operator("SELECT mode(l_returnflag) AS flag, nth_value_ AS fifth FROM lineitem, (SELECT list(p_name ORDER BY p_partkey)[5] AS nth_value_ FROM part) GROUP BY nth_value_")
def agg_mode_nth(t: Tables) -> DataFrame:
    """The value of the fifth key: the five least keys are all that each partial result holds."""
    fifth = t.part.select("p_partkey", "p_name").orderBy("p_partkey").limit(5).agg(F.max_by("p_name", "p_partkey").alias("fifth"))
    return t.lineitem.agg(F.mode("l_returnflag").alias("flag")).select("flag", fifth.scalar().alias("fifth"))
