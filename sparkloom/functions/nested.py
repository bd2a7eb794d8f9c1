"""Array, map and struct functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.base import Registry, Tables

R = Registry()


def array_slice(a: Column, first: int, last: int) -> Column:
    """Elements first to last, both included."""
    return F.slice(a, first, last - first + 1)


def array_has_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


@R.operator("""
SELECT n_nationkey, list_append([n_nationkey, 1, 2], 9) AS ap, list_prepend(9, [n_nationkey, 1, 2]) AS pr, list_concat([n_nationkey], [5, 6]) AS co, list_contains([n_nationkey, 1, 2], 2) AS ha,
       list_sort(list_distinct([n_nationkey, n_nationkey, 3])) AS di, [n_nationkey, 1, 2][2] AS el, len([n_nationkey, 1]) AS le, list_position([7, n_nationkey], n_nationkey) AS po,
       list_reverse([n_nationkey, 1, 2]) AS re, list_slice([n_nationkey, 1, 2, 3], 2, 3) AS sl, list_sort([3, n_nationkey, 1]) AS so, flatten([[n_nationkey], [1, 2]]) AS fl,
       array_to_string([n_nationkey, 1], '-') AS js, list_has_any([n_nationkey, 1], [1, 99]) AS ha1, list_has_all([n_nationkey, 1], [1]) AS ha2, list_max([n_nationkey, 12]) AS mx, list_min([n_nationkey, 12]) AS mn FROM nation""")
def fn_array_pack(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    lit = lambda *x: F.array(*(F.lit(i) if isinstance(i, int) else i for i in x))
    return t.nation.select(
        "n_nationkey", F.array_append(lit(k, 1, 2), 9).alias("ap"), F.array_prepend(lit(k, 1, 2), 9).alias("pr"), F.concat(lit(k), lit(5, 6)).alias("co"), F.array_contains(lit(k, 1, 2), 2).alias("ha"),
        F.array_sort(F.array_distinct(lit(k, k, 3))).alias("di"), F.element_at(lit(k, 1, 2), 2).alias("el"), F.size(lit(k, 1)).cast("bigint").alias("le"),
        F.when(k == 7, 1).otherwise(F.array_position(lit(7, k), k)).cast("int").alias("po"), F.reverse(lit(k, 1, 2)).alias("re"), array_slice(lit(k, 1, 2, 3), 2, 3).alias("sl"), F.array_sort(lit(3, k, 1)).alias("so"),
        F.flatten(F.array(lit(k), lit(1, 2))).alias("fl"), F.array_join(lit(k, 1).cast("array<string>"), "-").alias("js"), F.arrays_overlap(lit(k, 1), lit(1, 99)).alias("ha1"), array_has_all(lit(k, 1), lit(1)).alias("ha2"),
        F.array_max(lit(k, 12)).alias("mx"), F.array_min(lit(k, 12)).alias("mn"),
    )


@R.operator("""
SELECT list_sort(list_intersect([1, 2, 3, 4], [2, 4, 6])) AS i, list_sort(list_distinct(list_concat([1, 2], [2, 3]))) AS u, list_filter([1, 2, 1, 3], lambda x: x <> 1) AS rm, [5, 5, 5] AS rp, generate_series(1, 9, 3) AS ge,
       string_split('a,b,c', ',') AS sp, list_filter([1, 2, 3], lambda x: x <> 2) AS ex""")
def fn_array_sets(t: Tables) -> DataFrame:
    a = lambda *x: F.array(*map(F.lit, x))
    return t.spark.range(1).select(
        F.array_sort(F.array_intersect(a(1, 2, 3, 4), a(2, 4, 6))).alias("i"), F.array_sort(F.array_union(a(1, 2), a(2, 3))).alias("u"), F.array_remove(a(1, 2, 1, 3), 1).alias("rm"),
        F.array_repeat(F.lit(5), 3).alias("rp"), F.sequence(F.lit(1).cast("bigint"), F.lit(9).cast("bigint"), F.lit(3).cast("bigint")).alias("ge"), F.split(F.lit("a,b,c"), ",").alias("sp"), F.array_except(a(1, 2, 3), a(2)).alias("ex"),
    )


@R.operator("SELECT event_id, unnest(string_split(event_type, '_')) AS part FROM events")
def fn_unnest(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(F.split("event_type", "_")).alias("part"))


@R.operator("""
SELECT n_nationkey, map_keys(m) AS k, map_values(m) AS v, m[n_name] AS x, CAST(cardinality(m) AS BIGINT) AS n, s.a AS sa, s.b AS sb
FROM (SELECT n_nationkey, n_name, MAP {'id': n_nationkey, n_name: n_regionkey} AS m, {'a': n_nationkey, 'b': n_name} AS s FROM nation)""")
def fn_map_struct(t: Tables) -> DataFrame:
    m = F.create_map(F.lit("id"), F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey"))
    s = F.named_struct(F.lit("a"), F.col("n_nationkey"), F.lit("b"), F.col("n_name"))
    return t.nation.select("n_nationkey", "n_name", m.alias("m"), s.alias("s")).select(
        "n_nationkey", F.map_keys("m").alias("k"), F.map_values("m").alias("v"), F.element_at("m", F.col("n_name")).alias("x"), F.size("m").cast("bigint").alias("n"), F.col("s.a").alias("sa"), F.col("s.b").alias("sb")
    )


@R.operator("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))
