import decimal
import math

import duckdb
import pytest

from sparkloom.operators import ordering, registry


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_gives_what_its_sql_gives(spark, oracle, sf_dir, name):
    got = rows(registry.queries()[name](spark, sf_dir).toArrow())
    assert got == rows(oracle.execute(registry.oracle_sql()[name]).to_arrow_table())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = registry.queries()["filter_range_between"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan


def test_sorts_return_whole_tables_with_nulls_in_place(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    for name, source in (("order_multi_key", "customer"), ("order_nulls_first", "orders"), ("order_nulls_last", "orders")):
        got = registry.queries()[name](spark, folder).toPandas().sort_values("place")
        assert got.place.tolist() == list(range(1, spark.read.parquet(f"{folder}/{source}.parquet").count() + 1))
        if "nulls" in name:
            null = got.s.isna().tolist()
            assert 0 < sum(null) < len(null) and null == sorted(null, reverse="first" in name)


def test_numbered_empty(spark):
    assert ordering.numbered(spark.createDataFrame([], "a long").orderBy("a")).collect() == []


def test_null_order_and_full_join_cover_whole_tables(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    assert registry.queries()["sql_null_order"](spark, sf_dir).count() == read("orders")
    got = registry.queries()["join_full_outer"](spark, sf_dir).toPandas()
    assert got.s_suppkey.nunique() == read("supplier") and got.c_custkey.nunique() == read("customer")
    assert got.s_suppkey.isna().any() and got.c_custkey.isna().any() and got.dropna().shape[0] > 0
