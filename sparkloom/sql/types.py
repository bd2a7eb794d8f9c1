"""SQL type names and Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Spellings of the dialect.
NAMES = {
    "integer": "int", "int": "int", "int4": "int",
    "bigint": "bigint", "int8": "bigint",
    "smallint": "smallint", "int2": "smallint",
    "tinyint": "tinyint",
    "boolean": "boolean", "bool": "boolean",
    "float": "float", "real": "float", "float4": "float",
    "double": "double", "double precision": "double", "float8": "double",
    "varchar": "string", "text": "string", "string": "string", "char": "string", "character varying": "string", "character": "string",
    "blob": "binary", "bytea": "binary",
    "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz",
    "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
    "date": "date",
    "json": "string", "jsonb": "string",
}

_ARRAY = re.compile(r"^(.*?)\s*\[\s*\d*\s*\]$")
_DECIMAL = re.compile(r"^(?:decimal|numeric)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?$")
_SIZED = re.compile(r"^(.*?)\s*\(\s*(\d+)\s*\)\s*(.*)$")


def spark_type(sql_type: str) -> str:
    """Spark's name of a type; an unknown one is held as a string."""
    name = " ".join(sql_type.lower().split())
    if m := _ARRAY.match(name):
        return f"array<{spark_type(m[1])}>"
    if m := _DECIMAL.match(name):
        return f"decimal({m[1] or 38},{m[2] or (0 if m[1] else 10)})"
    if m := _SIZED.match(name):
        name = f"{m[1]} {m[3]}".strip()
    return NAMES.get(name, "string")


def holds_digest(sql_type: str) -> bool:
    """Whether a column can hold 64 characters."""
    name = " ".join(sql_type.lower().split())
    m = _SIZED.match(name)
    return spark_type(name) == "string" and name.split("(")[0].split()[0] in ("varchar", "text", "string", "character", "char") and (m is None or int(m[2]) >= 64)


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(spark_type(t)), True) for n, t in columns]) if columns else T.StructType()
