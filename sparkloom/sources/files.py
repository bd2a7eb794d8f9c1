"""File sources and sinks; schemas are stated or taken from the files, never inferred by a second pass over text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Options that make text formats strict: a malformed row is an error, not a NULL.
STRICT = {"csv": {"header": "true", "mode": "FAILFAST"}, "json": {"mode": "FAILFAST"}}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """The rows of files; CSV and JSON need a schema."""
    if kind in STRICT and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**{**STRICT.get(kind, {}), **options})
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Write rows; `by` names columns that become folders, whose rows are gathered first so that each folder gets few files."""
    base = {"header": "true"} if kind == "csv" else {}
    rows = df.repartition(*by) if by else df
    writer = rows.write.mode(mode).options(**{**base, **options}).format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)
