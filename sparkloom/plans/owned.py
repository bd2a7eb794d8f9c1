"""What the engine itself adds to Spark: pseudonyms, shards, copy-on-write tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import Registry, Tables
from ..operators.ordering import numbered
from ..session import work_folder
from ..sql.engine import Engine
from ..sql.errors import EngineError
from ..sql.pseudonyms import digest_column, digest_sql

R = Registry()

#: The key of the examples; a real one comes from the secrets table.
EXAMPLE_KEY = "an example key"


@R.operator(f"SELECT c_custkey, {digest_sql(EXAMPLE_KEY, 'c_name')} AS pseudonym FROM customer")
def pseudonymize_column(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", digest_column(EXAMPLE_KEY, F.col("c_name")).alias("pseudonym"))


def engine(t: Tables, *tables: str) -> Engine:
    """An engine in a folder of its own, with some of the Parquet tables registered."""
    own = Engine(t.spark, work_folder(t.spark, "engine"))
    for name in tables:
        own.register(name, f"{t.folder}/{name}.parquet")
    return own


@R.operator("SELECT * FROM (VALUES (1, 'one', 10), (2, 'changed', 21), (4, 'four', NULL)) v(id, name, n)")
def dml_insert_update_delete(t: Tables) -> DataFrame:
    own = engine(t)
    own.execute("""
        CREATE TABLE a (id INTEGER NOT NULL, name VARCHAR, n INTEGER) WITH (shards = 3, shard_by = 'id');
        INSERT INTO a (id, name, n) VALUES (1, 'one', 10), (2, 'two', 20), (3, 'three', 30), (4, 'four', NULL);
        UPDATE a SET name = 'changed', n = n + 1 WHERE id = 2;
        DELETE FROM a WHERE n >= 30""")
    return own.query("SELECT id, name, n FROM a")


@R.operator("SELECT * FROM (VALUES (1, CAST(NULL AS BIGINT), 'a'), (2, 5, 'b')) v(id, n, label)")
def alter_add_column_read(t: Tables) -> DataFrame:
    own = engine(t)
    own.execute("""
        CREATE TABLE a (id INTEGER NOT NULL, name VARCHAR);
        INSERT INTO a (id, name) VALUES (1, 'a');
        ALTER TABLE a ADD COLUMN n INTEGER, RENAME COLUMN name TO label;
        INSERT INTO a (id, label, n) VALUES (2, 'b', 5);
        ALTER TABLE a ALTER COLUMN n TYPE BIGINT""")
    return own.query("SELECT id, n, label FROM a")


@R.operator("""
SELECT * FROM (VALUES ('a', 'id', 1, 'INTEGER', false), ('a', 'name', 2, 'VARCHAR(20)', true)) v(table_name, column_name, ordinal_position, data_type, is_nullable)""")
def catalog_columns(t: Tables) -> DataFrame:
    own = engine(t)
    own.execute("CREATE TABLE a (id INTEGER NOT NULL, name VARCHAR(20))")
    return own.query("SELECT table_name, column_name, ordinal_position, data_type, is_nullable FROM engine_catalog.columns")


@R.operator("SELECT 'HASH' AS shard_strategy, 'k' AS shard_key, 4 AS shard_count, 2 AS replication_factor, 4 AS shards")
def catalog_tables(t: Tables) -> DataFrame:
    own = engine(t)
    own.execute("CREATE TABLE a (id INTEGER, k BIGINT) WITH (shards = 4, replication_factor = 2, shard_by = 'HASH(k)')")
    return own.query("""
        SELECT shard_strategy, shard_key, shard_count, replication_factor, CAST(count(*) AS INTEGER) AS shards
        FROM engine_catalog.tables t JOIN engine_catalog.shards s ON t.table_name = s.table_name GROUP BY 1, 2, 3, 4""")


@R.operator("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def shard_prune_point(t: Tables) -> DataFrame:
    """A sharded copy of orders, read at one key: only the files of its shard are listed."""
    own = engine(t)
    own.execute("CREATE TABLE o (o_orderkey BIGINT NOT NULL, o_custkey BIGINT, o_orderstatus VARCHAR) WITH (shards = 8, shard_by = 'o_orderkey')")
    own.append("o", own.spark.read.parquet(f"{t.folder}/orders.parquet"))
    return own.query("SELECT o_orderkey, o_custkey, o_orderstatus FROM o WHERE o_orderkey = 77.0")


@R.operator("SELECT count(*) AS n, 8 AS shards, true AS even FROM orders")
def shard_distribution(t: Tables) -> DataFrame:
    """All rows arrive, in all shards, none with twice its share."""
    own = engine(t)
    own.execute("CREATE TABLE o (o_orderkey BIGINT NOT NULL, o_totalprice DOUBLE) WITH (shards = 8)")
    own.append("o", own.spark.read.parquet(f"{t.folder}/orders.parquet"))
    by = own.catalog.read(own.catalog.get("o")).groupBy("_shard").agg(F.count(F.lit(1)).alias("m"))
    return by.agg(F.sum("m").alias("n"), F.count(F.lit(1)).cast("int").alias("shards"), (F.max("m") < F.sum("m") / 4).alias("even"))


@R.operator("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def sql_distinct_on(t: Tables) -> DataFrame:
    return engine(t, "orders").query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")


@R.operator("SELECT p_brand, p_partkey FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) <= 3")
def sql_qualify(t: Tables) -> DataFrame:
    return engine(t, "part").query("SELECT p_brand, p_partkey FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) <= 3")


@R.operator("""
SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS told, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, ends_with(event_type, 'k') AS k, 'type: ' || upper(event_type) AS label, [event_id, user_id] AS both
FROM events WHERE event_type ILIKE 'C%' AND regexp_matches(event_type, 'k$')""")
def sql_dialect(t: Tables) -> DataFrame:
    return engine(t, "events").query(r"""
        SELECT event_id, TO_CHAR(ts, 'DD.MM.YYYY HH24:MI') AS told, date_trunc('hour', ts) AS hour, ends_with(event_type, 'k') AS k, 'type: ' || upper(event_type) AS label, ARRAY[event_id, user_id] AS both
        FROM public.events WHERE event_type ILIKE 'C%' AND event_type ~ 'k$'  -- a comment; with a stop""")


@R.operator("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000.5")
def sql_prepared(t: Tables) -> DataFrame:
    return engine(t, "customer").prepare("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = $1 AND c_acctbal > $2").execute(["BUILDING", 1000.5]).frame


@R.operator("SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'P') DESC NULLS FIRST, o_orderkey) AS place FROM orders")
def sql_null_order(t: Tables) -> DataFrame:
    ordered = engine(t, "orders").query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s DESC, o_orderkey")
    return numbered(ordered).select("o_orderkey", "place")


def sharded_orders(t: Tables) -> Engine:
    own = engine(t)
    own.execute("CREATE TABLE o (o_orderkey BIGINT NOT NULL, o_orderdate DATE, o_totalprice DOUBLE) WITH (shards = 8, shard_by = 'o_orderkey')")
    own.append("o", own.spark.read.parquet(f"{t.folder}/orders.parquet").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS o_orderdate", "o_totalprice"))
    return own


@R.operator("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE NOT o_orderkey = 5")
def shard_not_equal(t: Tables) -> DataFrame:
    """A negated key prunes nothing."""
    return sharded_orders(t).query("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM o WHERE NOT o_orderkey = 5")


@R.operator("SELECT o_orderkey FROM orders WHERE o_orderkey = 77 OR o_orderkey % 1000 = 1")
def dml_delete_not_key(t: Tables) -> DataFrame:
    own = sharded_orders(t)
    own.execute("DELETE FROM o WHERE NOT o_orderkey = 77 AND NOT o_orderkey % 1000 = 1")
    return own.query("SELECT o_orderkey FROM o")


@R.operator("SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) GROUP BY 1")
def shard_date_key(t: Tables) -> DataFrame:
    """A key of dates is found by a literal whichever way its rows came."""
    own = engine(t)
    own.execute("CREATE TABLE d (k DATE NOT NULL, n BIGINT) WITH (shards = 16, shard_by = 'k')")
    orders = own.spark.read.parquet(f"{t.folder}/orders.parquet").selectExpr("CAST(o_orderdate AS DATE) AS k", "1L AS n")
    last = orders.agg(F.max("k")).first()[0]
    own.append("d", orders.where(F.col("k") < last))
    own.append("d", orders.where(F.col("k") == last))
    return own.query(f"SELECT k AS d, count(*) AS n FROM d WHERE k = '{last}' GROUP BY k")


@R.operator("SELECT * FROM (VALUES ('INSERT 0 3', 3), ('UPDATE 2', 2), ('UPDATE 0', 0), ('DELETE 1', 1)) v(tag, affected)")
def dml_affected(t: Tables) -> DataFrame:
    own = engine(t)
    own.execute("CREATE TABLE a (id INTEGER NOT NULL, n INTEGER)")
    done = own.execute("INSERT INTO a (id, n) VALUES (1, 1), (2, 1), (3, 2); UPDATE a SET n = 5 WHERE n = 1; UPDATE a SET n = 6 WHERE n = 1; DELETE FROM a WHERE id = 3")
    return own.spark.createDataFrame([(r.tag, r.affected) for r in done], "tag string, affected int")


#: Statements that are refused, and their SQLSTATE.
REFUSED = (
    ("INSERT INTO a (id, n) SELECT 1, 2", "0A000"),
    ("INSERT INTO a (id, n) VALUES (NULL, 2)", "0A000"),
    ("UPDATE a SET id = 2", "0A000"),
    ("UPDATE a SET x = 2", "42703"),
    ("SELECT x FROM a", "42703"),
    ("SELECT 1 FROM nowhere", "42P01"),
    ("CREATE TABLE a (id INTEGER)", "42P07"),
    ("CREATE TABLE b (id INTEGER) WITH (replication_factor = 99)", "0A000"),
    ("ALTER TABLE a ADD COLUMN n INTEGER", "42701"),
    ("SELEC 1", "0A000"),
    ("TRUNCATE TABLE a", "0A000"),
)


@R.operator("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{state}')" for i, (_, state) in enumerate(REFUSED)) + ") v(statement, sqlstate)")
def sql_refused(t: Tables) -> DataFrame:
    own, found = engine(t), []
    own.execute("CREATE TABLE a (id INTEGER NOT NULL, n INTEGER)")
    for i, (text, _) in enumerate(REFUSED):
        try:
            own.execute(text)
            found.append((i, "accepted"))
        except EngineError as e:
            found.append((i, e.sqlstate))
    return own.spark.createDataFrame(found, "statement int, sqlstate string")


@R.operator("SELECT * FROM (VALUES ('a', 'id', 1, 'NO'), ('a', 'kept', 2, 'YES')) v(table_name, column_name, ordinal_position, is_nullable)")
def information_schema_columns(t: Tables) -> DataFrame:
    own = engine(t)
    own.execute("CREATE TABLE a (id INTEGER NOT NULL, gone VARCHAR, kept VARCHAR); ALTER TABLE a DROP COLUMN gone")
    return own.query("SELECT table_name, column_name, ordinal_position, is_nullable FROM information_schema.columns WHERE table_schema = 'public'")


@R.operator("""
SELECT o_orderkey, gcd(o_orderkey, 36) AS g, lcm(o_orderkey, 10) AS l, trunc(-o_totalprice) AS t, time_bucket(INTERVAL '7 days', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1970-01-01') AS bin,
       string_split(o_orderstatus || '.' || o_orderkey, '.')[2] AS part, len(['a', 'b', o_orderstatus]) AS n, regexp_matches(o_orderstatus, '^(F|O)$') AS fo
FROM orders""")
def sql_functions(t: Tables) -> DataFrame:
    return engine(t, "orders").query("""
        SELECT o_orderkey, gcd(o_orderkey, 36) AS g, lcm(o_orderkey, 10) AS l, trunc(-o_totalprice) AS t, date_bin(INTERVAL '7 days', CAST(o_orderdate AS TIMESTAMP)) AS bin,
               string_to_array(o_orderstatus || '.' || CAST(o_orderkey AS VARCHAR), '.')[2] AS part, CAST(array_length(ARRAY['a', 'b', o_orderstatus], 1) AS BIGINT) AS n, o_orderstatus SIMILAR TO '(F|O)' AS fo
        FROM orders""")


@R.operator("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM part WHERE p_size > 3")
def sql_groups_frame(t: Tables) -> DataFrame:
    return engine(t, "part").query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM part WHERE p_size > 3")


@R.operator("""
WITH big AS (SELECT * FROM part WHERE p_size > 10)
SELECT p_brand, p_partkey FROM big QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1
UNION ALL SELECT * FROM (SELECT DISTINCT ON (p_type) p_type, p_partkey FROM part ORDER BY p_type, p_partkey)""")
def sql_qualify_cte(t: Tables) -> DataFrame:
    return engine(t, "part").query("""
        WITH big AS (SELECT * FROM part WHERE p_size > 10)
        SELECT p_brand, p_partkey FROM big QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1
        UNION ALL SELECT * FROM (SELECT DISTINCT ON (p_type) p_type, p_partkey FROM part ORDER BY p_type, p_partkey) d""")


@R.operator("SELECT p_brand, p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS run FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def sql_named_window(t: Tables) -> DataFrame:
    return engine(t, "part").query("SELECT p_brand, p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS run FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")


@R.operator("SELECT * FROM (VALUES ('a', 'id', 'int4', 1, true), ('a', 'name', 'text', 2, false), ('a', 'price', 'numeric', 3, false)) v(relname, attname, typname, attnum, attnotnull)")
def pg_catalog_columns(t: Tables) -> DataFrame:
    own = engine(t)
    own.execute("CREATE TABLE a (id INTEGER NOT NULL, name VARCHAR, price DECIMAL(10, 2))")
    return own.query("""
        SELECT relname, attname, typname, attnum, attnotnull FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace n ON c.relnamespace = n.oid
        JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_catalog.pg_type y ON y.oid = a.atttypid WHERE nspname = 'public' AND relkind = 'r'""")
