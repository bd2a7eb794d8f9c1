"""INSERT, UPDATE and DELETE by copy-on-write: new files are staged, then one record replaces the old one."""

from __future__ import annotations

import uuid
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import routing
from .catalog import Catalog, Table
from .errors import EngineError, not_supported
from .lexer import Cursor, Token
from .pseudonyms import ALGORITHM, digest
from .rewrite import literal, spark_sql
from .types import spark_type

SECRETS = "anonymization_secret"


#: Files of a shard and tier that small INSERTs may leave; then they become one file of the next tier.
TIER_FILES = 64


def stage(catalog: Catalog, table: Table, rows: DataFrame, tier: int | None = None) -> list[tuple[int, str]]:
    """Write physical rows with `_shard` to new files of the table; returns them. Files of small INSERTs have a tier."""
    folder = f"{table.folder}/_stage={'s' if tier is None else f't{tier}x'}{uuid.uuid4().hex}"
    rows.write.partitionBy("_shard").parquet(folder)
    found = []
    for part in catalog.files.names(folder):
        if part.startswith("_shard="):
            found += [(int(part[7:]), f"{folder}/{part}/{n}") for n in catalog.files.names(f"{folder}/{part}") if n.endswith(".parquet")]
    return found


def _merge_tiers(catalog: Catalog, table: Table, shards: set[int]) -> None:
    """Make one file of each tier that is full, so n single INSERTs leave files in proportion to log n and write each row log n times."""
    tier = 0
    while True:
        mark = f"/_stage=t{tier}x"
        own = [f for f in table.files if f[0] in shards and mark in f[1]]
        count = Counter(f[0] for f in own)
        full = [f for f in own if count[f[0]] >= TIER_FILES]
        if full:
            rows = catalog.read(Table(**{**table.__dict__, "files": full}), physical=True)
            made = stage(catalog, table, rows.repartition(len(set(f[0] for f in full)), "_shard"), tier + 1)
            table.files = [f for f in table.files if f not in set(full)] + made
        elif not any(f"/_stage=t{tier + 1}x" in f[1] for f in table.files):
            return
        tier += 1


def vacuum(catalog: Catalog, name: str) -> int:
    """Delete folders of files that no kept record of a table names; returns how many."""
    table, gone = catalog.get(name), 0
    live = {path.rpartition("/_shard=")[0].rpartition("/")[2] for _, path in catalog.kept_files(name)}
    for folder in catalog.files.names(table.folder):
        if folder.startswith("_stage=") and folder not in live:
            catalog.files.delete(f"{table.folder}/{folder}")
            gone += 1
    return gone


def _secret(catalog: Catalog, id_: str, known: dict[str, str]) -> str:
    if id_ not in known:
        secret = catalog.secrets().get(id_)
        if secret is None:
            raise EngineError("CATALOG_ACCESS_ERROR", f'secret "{id_}" does not exist')
        if secret["algo"] != ALGORITHM:
            raise not_supported(f"the algorithm {secret['algo']}")
        known[id_] = secret["secret_key"]
    return known[id_]


def _pseudonym(catalog: Catalog, table: Table, column: str, value: list[Token], bound: bool, known: dict[str, str]) -> list[Token]:
    """A literal's digest as a literal; NULL stays."""
    id_ = table.anonymized.get(column)
    if id_ is None:
        return value
    text = routing.literal_text(value)
    if text is None or bound:
        raise not_supported(f'a value other than a literal for the anonymized column "{column}"')
    if text == "null":
        return value
    plain = value[0].string if value[0].kind == "string" else text
    return [Token("string", f"'{digest(_secret(catalog, id_, known), plain)}'")]


def insert(catalog: Catalog, cursor: Cursor, bound: set[int]) -> int:
    """bound: ids of the tokens that stand for bind parameters."""
    cursor.expect("INTO")
    schema, name = cursor.qualified()
    if name == SECRETS and schema in ("engine_catalog", ""):
        return _insert_secrets(catalog, cursor)
    table = catalog.get(name)
    if cursor.peek().text != "(":
        raise not_supported("INSERT without a list of columns")
    names = [c[0].name for c in cursor.parenthesized()]
    columns = [table.column(n) for n in names]
    if len(set(names)) < len(names):
        raise EngineError("SQL_SYNTAX_ERROR", "a column is named twice")
    if table.shard_key not in names:
        raise not_supported(f'INSERT without the shard key "{table.shard_key}"')
    if not cursor.take("VALUES"):
        raise not_supported("INSERT other than VALUES")
    known: dict[str, str] = {}
    rows: list[str] = []
    shards: set[int] = set()
    while True:
        values = cursor.parenthesized()
        if len(values) != len(names):
            raise EngineError("SQL_SYNTAX_ERROR", "a row has another number of values than columns")
        values = [_pseudonym(catalog, table, n, v, any(id(t) in bound for t in v), known) for n, v in zip(names, values, strict=True)]
        key, kind = values[names.index(table.shard_key)], spark_type(table.column(table.shard_key).sql_type)
        text = routing.literal_text(key)
        if text == "null":
            raise not_supported(f'NULL in the shard key "{table.shard_key}"')
        given = {n: f"CAST({spark_sql(v)} AS {spark_type(c.sql_type)})" for n, v, c in zip(names, values, columns, strict=True)}
        text = None if text is None else routing.typed_text(text, kind)
        if text is None:  # evaluated once: the row holds the value that was routed
            text, shown = _evaluated(catalog, given[table.shard_key])
            given[table.shard_key] = f"CAST({literal(shown)} AS {kind})"
        shard = routing.shard_of(text, table.shards)
        shards.add(shard)
        rows.append("(" + ", ".join([*(given.get(c.name) or _default(c) for c in table.columns), str(shard)]) + ")")
        if not cursor.take(","):
            break
    if not cursor.done:
        raise not_supported(f"{cursor.peek().text} in INSERT")
    aliases = ", ".join([*(c.physical for c in table.columns), "_shard"])
    frame = catalog.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v({aliases})").select(
        *(F.col(c.physical).cast(spark_type(c.sql_type)) for c in table.columns), F.col("_shard").cast("int")
    )
    _check(catalog, table, frame, shards)
    version = table.version
    table.files += stage(catalog, table, frame.coalesce(1), 0)
    _merge_tiers(catalog, table, shards)
    catalog.put(table, version)
    return len(rows)


def _default(column) -> str:
    from .lexer import tokens

    return f"CAST({spark_sql(tokens(column.default)) if column.default else 'NULL'} AS {spark_type(column.sql_type)})"


def _evaluated(catalog: Catalog, value: str) -> tuple[str, str]:
    """The text by which a value is routed, and the value as a string."""
    found = catalog.spark.sql(f"SELECT v, CAST(v AS STRING) AS s FROM (SELECT {value} AS v)").first()
    if found["v"] is None:
        raise not_supported("NULL in the shard key")
    return routing.key_text(found["v"]), found["s"]


def _check(catalog: Catalog, table: Table, rows: DataFrame, shards: set[int] | None = None) -> None:
    """NOT NULL and PRIMARY KEY of new rows (physical names), which lie in these shards."""
    _not_null(rows, [(c.name, c.physical) for c in table.columns if not c.nullable])
    if table.primary_key:
        key = [table.column(n).physical for n in table.primary_key]
        held = catalog.read(table, shards if table.shard_key in table.primary_key else None, physical=True)
        both = rows.select(*key, F.lit(1).alias("_new")).unionByName(held.select(*key, F.lit(0).alias("_new")))
        if both.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("_new").alias("new")).where("n > 1 AND new = 1").limit(1).count():
            raise EngineError("ENGINE_ERROR", f'a row violates the primary key of "{table.name}"', sqlstate="23505")


def _not_null(rows: DataFrame, columns: list[tuple[str, str]]) -> None:
    """One pass over rows for all columns (name, name in rows) that may not be NULL."""
    if columns:
        found = rows.agg(*(F.max(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, (_, c) in enumerate(columns))).first()
        for (name, _), null in zip(columns, found, strict=True):
            if null:
                raise EngineError("ENGINE_ERROR", f'NULL in column "{name}" violates NOT NULL', sqlstate="23502")


def append(catalog: Catalog, name: str, rows: DataFrame) -> None:
    """Append a whole frame to a table; its columns are found by name. Keys are hashed batch by batch on the executors."""
    table = catalog.get(name)
    if table.anonymized:
        raise not_supported("appending a frame to a table with anonymized columns")
    missing = {c.name for c in table.columns} - set(rows.columns)
    own = rows.select(*(F.lit(None).cast(spark_type(c.sql_type)).alias(c.physical) if c.name in missing else F.col(f"`{c.name}`").cast(spark_type(c.sql_type)).alias(c.physical) for c in table.columns))
    key, shards = table.column(table.shard_key).physical, table.shards

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        number = {k: routing.shard_of(routing.key_text(k), shards) for k in keys.unique()}
        return keys.map(number).astype("int32")

    if own.where(F.col(key).isNull()).limit(1).count():
        raise not_supported(f'NULL in the shard key "{table.shard_key}"')
    placed = own.withColumn("_shard", shard(F.col(key)))
    _check(catalog, table, own)
    version = table.version
    # Each task writes the rows of few shards; AQE splits a shard that is too large for one of them.
    table.files += stage(catalog, table, placed.hint("rebalance", F.col("_shard")))
    catalog.put(table, version)


def _insert_secrets(catalog: Catalog, cursor: Cursor) -> int:
    names = [c[0].name for c in cursor.parenthesized()]
    if sorted(names) != ["algo", "id", "secret_key"]:
        raise not_supported("a secret without id, algo and secret_key")
    cursor.expect("VALUES")
    count = 0
    while True:
        values = cursor.parenthesized()
        if any(len(v) != 1 or v[0].kind != "string" for v in values) or len(values) != 3:
            raise not_supported("a secret other than three string literals")
        row = dict(zip(names, (v[0].string for v in values), strict=True))
        catalog.add_secret(row["id"], row["algo"], row["secret_key"])
        count += 1
        if not cursor.take(","):
            return count


def _target(table: Table, where: list[Token]) -> set[int] | None:
    """The shard that the WHERE clause fixes, or None for all."""
    text = routing.key_literal(where, table.shard_key) if where else None
    if text is None:
        return None
    if text == "null":
        raise not_supported("a comparison of the shard key with NULL")
    text = routing.typed_text(text, spark_type(table.column(table.shard_key).sql_type))
    return None if text is None else {routing.shard_of(text, table.shards)}


def _alias(cursor: Cursor, table: Table, *stops: str) -> str:
    """The name by which a statement calls its table."""
    cursor.take("AS")
    return cursor.identifier() if cursor.peek().is_name and cursor.peek().upper not in stops else table.name


def update(catalog: Catalog, cursor: Cursor, bound: set[int], resolve) -> int:
    """resolve: makes the relations that tokens name readable and gives their SQL."""
    table = catalog.get(cursor.qualified()[1])
    alias = _alias(cursor, table, "SET")
    cursor.expect("SET")
    known: dict[str, str] = {}
    changes: dict[str, list[Token]] = {}
    while True:
        if cursor.peek().text == "(":
            raise not_supported("assigning to a list of columns")
        name = cursor.identifier()
        table.column(name)
        if name == table.shard_key:
            raise not_supported(f'changing the shard key "{name}"')
        cursor.expect("=")
        value = cursor.until(",", "WHERE", "FROM", "RETURNING")
        changes[name] = _pseudonym(catalog, table, name, value, any(id(t) in bound for t in value), known)
        if not cursor.take(","):
            break
    others = cursor.until("WHERE", "RETURNING") if cursor.take("FROM") else []
    return _rewrite(catalog, table, alias, others, _where(cursor), changes, resolve)


def delete(catalog: Catalog, cursor: Cursor, resolve) -> int:
    cursor.expect("FROM")
    table = catalog.get(cursor.qualified()[1])
    alias = _alias(cursor, table, "WHERE", "USING", "RETURNING")
    others = cursor.until("WHERE", "RETURNING") if cursor.take("USING") else []
    return _rewrite(catalog, table, alias, others, _where(cursor), None, resolve)


def _where(cursor: Cursor) -> list[Token]:
    found = cursor.until("RETURNING") if cursor.take("WHERE") else []
    if not cursor.done:
        raise not_supported(cursor.peek().text)
    return found


def _rewrite(catalog: Catalog, table: Table, alias: str, others: list[Token], where: list[Token], changes: dict[str, list[Token]] | None, resolve) -> int:
    """Write anew the files that hold rows of the WHERE clause; the others stay. changes: new values, None to delete.

    One query tells the places of the rows that are hit, and their new values; it may name other relations and hold subqueries. Of
    several rows that a row of the table meets, one gives the values.
    """
    shards = None if others else _target(table, where)  # a term may be of another relation
    view = f"_target_{uuid.uuid4().hex}"
    place = (F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    live = [f for f in table.files if shards is None or f[0] in shards]
    rows = catalog.read(table, shards, physical=True).select(*(F.col(c.physical).alias(c.name) for c in table.columns), *(place if live else (F.lit("").alias("_path"), F.lit(0).alias("_row"))))
    rows.createOrReplaceTempView(view)
    try:
        values = [f"CAST({spark_sql(v)} AS {spark_type(table.column(n).sql_type)}) AS _v{i}" for i, (n, v) in enumerate((changes or {}).items())]
        called = "`" + alias.replace("`", "``") + "`"
        text = f"SELECT {', '.join([f'{called}._path', f'{called}._row', *values])} FROM {view} AS {called}"
        if others:
            text += ", " + resolve(others, True)
        if where:
            text += f" WHERE {resolve(where, False)}"
        found = catalog.spark.sql(text)
        if others:
            found = found.dropDuplicates(["_path", "_row"])
        if not live:
            found.limit(0).count()  # names are checked all the same
            return 0
        hits = materialized(catalog, table, found)
        by_file = {r[0]: r[1] for r in hits.groupBy("_path").agg(F.count(F.lit(1))).collect()}
        if not by_file:
            return 0
        tail = lambda p: p.rpartition(table.folder.rpartition("/")[2])[2]
        touched = {tail(p) for p in by_file}
        old = [f for f in table.files if tail(f[1]) in touched]
        part = Table(**{**table.__dict__, "files": old})
        every = catalog.read(part, physical=True).select(*(c.physical for c in table.columns), "_shard", *place)
        if changes is None:
            after = every.join(hits, ["_path", "_row"], "left_anti")
        else:
            number = {n: i for i, n in enumerate(changes)}
            met = every.join(hits.withColumn("_hit", F.lit(True)), ["_path", "_row"], "left")
            after = met.select(*((F.when(F.col("_hit"), F.col(f"_v{number[c.name]}")).otherwise(F.col(c.physical)).alias(c.physical) if c.name in number else F.col(c.physical)) for c in table.columns), "_shard")
            _not_null(after, [(c.name, c.physical) for c in table.columns if c.name in number and not c.nullable])
        physical = after.select(*(c.physical for c in table.columns), "_shard")
        version = table.version
        new = stage(catalog, table, physical)
        table.files = [f for f in table.files if f not in old] + new
        catalog.put(table, version)
        return sum(by_file.values())
    finally:
        catalog.spark.catalog.dropTempView(view)


def materialized(catalog: Catalog, table: Table, found: DataFrame) -> DataFrame:
    """The hits of a statement, written once beside the table's files: what they name must not change between two scans."""
    folder = f"{table.folder}/_stage=h{uuid.uuid4().hex}"
    found.write.parquet(folder)
    return catalog.spark.read.schema(found.schema).parquet(folder)


def bind(items: list[Token], params: list) -> tuple[list[Token], set[int]]:
    """Tokens with literals for $n, and the ids of those literals."""
    out, bound = [], set()
    for t in items:
        if t.kind == "param":
            made = _literal_tokens(params[int(t.text[1:]) - 1])
            out += made
            bound |= {id(x) for x in made}
        else:
            out.append(t)
    return out, bound


def _literal_tokens(value) -> list[Token]:
    if value is None:
        return [Token("word", "NULL")]
    if isinstance(value, bool):
        return [Token("word", str(value).upper())]
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        text = repr(value) if isinstance(value, float) else str(value)
        return [Token("op", "-"), Token("number", text[1:])] if text[0] == "-" else [Token("number", text)]
    if isinstance(value, (bytes, bytearray)):
        return [Token("word", "unhex"), Token("op", "("), Token("string", f"'{bytes(value).hex()}'"), Token("op", ")")]
    return [Token("string", "'" + str(value).replace("'", "''") + "'")]


