"""The corpus pipeline: stages over documents, each written as Parquet and read again for the next one.

A stage reads all rows its predecessor kept and returns the columns of documents (the last one: packed pieces). Rows are
known by their place (file and row in it), so rows that share a doc_id, or have none, are judged one by one.

Defined results: null texts are empty texts throughout; a table without rows passes as one; columns beyond those of documents
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import PLACE, file_rows, made, materialize, placed, release, small_batches, table
from sparkloom.llm.exact_dedup import dedup_exact
from sparkloom.llm.near_dedup import near_classes
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.rules import THRESHOLD, accepted, fit_quality
from sparkloom.llm.substring import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CAPACITY, END_ID = 4096, 1


def _kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs, known by their places, that were judged to be kept."""
    return placed(docs, COLUMNS).join(judged.where("kept").select(*PLACE), list(PLACE), "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    small_batches(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return accepted(docs.select(*COLUMNS), model, THRESHOLD).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    small_batches(spark)
    docs = file_rows(docs, COLUMNS)
    return _kept(docs, dedup_exact(placed(docs, COLUMNS), carry=PLACE))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the smallest doc_id."""
    small_batches(spark)
    docs = file_rows(docs, COLUMNS)
    return _kept(docs, near_classes(docs, place=True))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in a document with a smaller doc_id; texts that lose all their words go."""
    small_batches(spark)
    found = dedup_substrings(docs, text=True, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    left = found.where(~changed | (F.col("n_removed") < F.col("n_words")))
    return left.select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their sequences and places in them."""
    import public_tokenizers

    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, CAPACITY)


#: (name, function of (spark, docs, sf_dir)).
STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, held, keep=1)  # what the stage read and made on its way; its result is the last table made
    return docs


#: A fitted model, signatures and packing have no SQL form; a test compares run() with a brute-force version.
ORACLE_SQL = None
