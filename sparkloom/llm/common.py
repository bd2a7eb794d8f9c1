"""What the operators of this folder share: tables, the shared folder, sizes."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The class of white space that the word-based operators use.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of an Arrow batch and of a batch that the Parquet reader decodes: texts may be long, so both hold few.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Bound what is decoded and handed to Python at once; results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def lean() -> None:
    """In a Python worker: let freed memory go back to the system, as many workers share a machine's memory.

    Workers are used again, by other stages too: what the task before has freed, Arrow's pool and the heap's gaps included, goes now.
    """
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-8, 1)  # one arena
        libc.mallopt(-3, 4 << 20)  # larger blocks are mapped, so they go when freed
        libc.mallopt(-1, 16 << 20)  # free memory at the heap's end beyond this goes
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and runs in a single process, as in tests, a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, until release()."""
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """The number of intermediate tables of this process that are not released."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the intermediate tables of this process but the first `since` and the last `keep`.

    Call it once the results that read them have been written.
    """
    jvm, gone = spark._jvm, _made[since : len(_made) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _made[since : len(_made) - keep]
    return len(gone)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, lineage cut.

    A lost executor costs only the tasks it ran; what has been written stays readable.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The columns that placed() adds.
PLACE = ("_file", "_row")


def file_rows(docs: DataFrame, columns: tuple[str, ...], place: bool = False) -> DataFrame:
    """The columns of docs from files: what is no scan of files is written first, so every scan gives the same rows in the same order."""
    own = docs.select(*columns)
    added = (F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    try:
        found = own.select(*columns, *added)
    except AnalysisException:
        own = materialize(own, "docs")
        found = own.select(*columns, *added)
    return found if place else own


def placed(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of docs with the place of each row (file and row in it), which stays the same in every scan.

    So rows that share a doc_id, or have none, are told apart and spread evenly.
    """
    return file_rows(docs, columns, True)


def source_bytes(docs: DataFrame) -> int:
    """The size of the files under docs, a scan of files, as the planner knows it, without reading any."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def blocks_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
