"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a Parquet table (digest, keep_id) in buckets of the digest, its files sorted by it, so the sort-merge
anti-join of a new batch reads it without a shuffle. Each batch adds a file to a bucket; with more than one of them Spark
sorts the bucket's rows as it reads, until compact() makes one sorted file a bucket again. A batch is digested once, reduced to one
row per digest (partial aggregation first, so a third of all rows may share a text), anti-joined and appended.

Defined results:
* null text counts as the empty text; empty texts are equal to each other;
* white space runs are one space, so a text of white space alone becomes one space, which is not the empty text;
* a null doc_id sorts after every number; of rows with equal doc_id and text exactly one stays;
* an empty batch gives no rows and leaves the index as it is;
* other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, scratch, shuffle_partitions, table


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_digest(text: Column) -> Column:
    """Lowercase hex of the SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalized(text), 256)


class DigestIndex:
    """Digests of all texts kept so far, at a path; opening it again in another session goes on with it.

    The table's name in the catalog comes from the whole path, so indexes are apart whatever their folders are called. The number
    of buckets is kept with the files: opening an index with another number is an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        fs, at = self._at(path)
        whole = fs.makeQualified(at).toString()
        self.name = "digest_index_" + hashlib.sha256(whole.encode()).hexdigest()[:32]
        held = self._kept_buckets()
        if held is None:
            self._keep_buckets()
        elif held != buckets:
            raise ValueError(f"the index at {path} has {held} buckets, not {buckets}")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{whole}'"
        )

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _kept_buckets(self) -> int | None:
        """The number in the names of files `_buckets-N`, which Spark does not read."""
        fs, at = self._at(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return next((int(n[9:]) for n in names if n.startswith("_buckets-")), None)

    def _keep_buckets(self) -> None:
        fs, at = self._at(f"{self.path}/_buckets-{self.buckets}")
        fs.create(at, True).close()

    def compact(self, path: str) -> DigestIndex:
        """A copy of the index at another path with one sorted file a bucket."""
        copy = DigestIndex(self.spark, path, self.buckets)
        self.table().repartition(self.buckets, "digest").write.insertInto(copy.name)
        self.spark.catalog.refreshTable(copy.name)
        return copy

    def drop(self) -> None:
        """Forget the index and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        fs, at = self._at(self.path)
        fs.delete(at, True)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """Dedupe docs (doc_id, text) against the index and themselves, append what is new, tell each row's fate.

        Returns doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256, and the columns of carry. A batch that is
        added again after a failure gets the same answer: a row that the index already names is kept.
        """
        rows = materialize(
            docs.select("doc_id", text_digest(F.col("text")).alias("digest"), *(F.col(c).alias(f"_carry_{c}") for c in carry)).withColumn("uid", F.monotonically_increasing_id()),
            "digests",
        )
        order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
        groups = materialize(
            rows.groupBy("digest")
            .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
            .join(self.table().withColumnRenamed("keep_id", "old_id").withColumn("old", F.lit(True)), "digest", "left")
            .select(
                "digest",
                "group_size",
                F.col("first.uid").alias("first_uid"),
                F.coalesce(F.col("old"), F.lit(False)).alias("old"),
                F.when(F.col("old"), F.col("old_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
            ),
            "digest-groups",
        )
        fresh = groups.join(self.table(), "digest", "left_anti").select("digest", "keep_id")
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        own = F.col("uid") == F.col("first_uid")
        return rows.join(groups, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            (own & (~F.col("old") | F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"),
            F.col("digest").alias("text_sha256"),
            *(F.col(f"_carry_{c}").alias(c) for c in carry),
        )


def dedup_exact(docs: DataFrame, index: DigestIndex | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's fate; without an index, against a new one."""
    spark = docs.sparkSession
    index = index or DigestIndex(spark, scratch(spark, "digest-index"), shuffle_partitions(spark))
    return index.add(docs, carry)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
