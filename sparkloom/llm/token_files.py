"""Token ids as binary files: a concatenated id array with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by doc_id, so a partition is a shard of consecutive documents; each
shard's task encodes its texts and writes segments of bounded size through Spark's writer, whose commit protocol
leaves exactly one copy whatever executors are lost, on any file system that Spark can write. A segment is one
self-contained binary value, laid out as

    magic "SLT1", id width u8, documents u64, ids u64, bytes of doc ids u64, bytes of boundaries u64,
    doc ids (64-bit each, compressed as byte planes), validity bits of doc ids, Elias-Fano boundaries, ids

little-endian. Only the shards' totals (one row a shard) are needed to know where each shard starts in the corpus.

Defined results: null text is the empty text, which still has its end id; equal doc_ids stand side by side in the
order of their texts' hashes; null doc_ids stand last; a table without rows gives no segments; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import bounded, expand, expand_bits, squeeze, squeeze_bits
from .common import blocks_for, file_rows, lean, scratch, source_bytes, table
from .elias_fano import EliasFano
from .tokens import encoder

MAGIC = b"SLT1"
_HEAD = struct.Struct("<4sBQQQQQ")

#: Bytes of input files of a shard, and ids of a segment, about.
SHARD_BYTES, SEGMENT_IDS = 16 << 20, 1 << 20

SEGMENTS = "shard int, segment int, first_id long, n_docs long, n_ids long, data binary"


class Segment:
    """Consecutive documents: their ids (numbers), the boundaries and the id array."""

    def __init__(self, doc_ids: pa.Array, boundaries: EliasFano, ids: np.ndarray):
        self.doc_ids, self.boundaries, self.ids = doc_ids, boundaries, ids

    @classmethod
    def of(cls, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> Segment:
        return cls(doc_ids, EliasFano.of(np.concatenate(([0], np.cumsum(sizes)))), ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.boundaries.select(i) : self.boundaries.select(i + 1)]

    def offsets(self) -> np.ndarray:
        """Where each document begins, and the end."""
        return self.boundaries.select(np.arange(self.boundaries.n))

    def to_bytes(self) -> bytes:
        known = self.doc_ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = squeeze(self.doc_ids.fill_null(0).to_numpy())
        valid, bounds = squeeze_bits(known), self.boundaries.to_bytes()
        head = _HEAD.pack(MAGIC, self.ids.itemsize, len(self.doc_ids), len(self.ids), len(numbers), len(valid), len(bounds))
        return head + numbers + valid + bounds + self.ids.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Segment:
        magic, width, docs, ids, a, b, c = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        numbers, valid = expand(data[at : at + a], np.int64), expand_bits(data[at + a : at + a + b], docs)
        bounds = EliasFano.from_bytes(data[at + a + b : at + a + b + c])
        array = np.frombuffer(data, f"<u{width}", ids, at + a + b + c)
        return cls(pa.array(numbers, pa.int64(), mask=~valid), bounds, array)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Encode docs (doc_id, text) and write their segments below path."""
    rows = file_rows(docs, ("doc_id", "text")).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = source_bytes(rows)
    shards = blocks_for(total, SHARD_BYTES, min(docs.sparkSession.sparkContext.defaultParallelism, blocks_for(total, 1 << 20)))
    kinds = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        own = encoder(tokenizer)
        shard, first, count, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush():
            nonlocal first, count, held, size
            doc_ids, ids, sizes = zip(*held, strict=True)
            seg = Segment.of(pa.concat_arrays(doc_ids), np.concatenate(sizes), np.concatenate(ids))
            row = {"shard": [shard], "segment": [count], "first_id": [first], "n_docs": [len(seg.doc_ids)], "n_ids": [len(seg.ids)], "data": [seg.to_bytes()]}
            first, count, held, size = first + len(seg.ids), count + 1, [], 0
            return pa.RecordBatch.from_pydict(row, schema=kinds)

        for batch in batches:
            for a, b in bounded(pc.binary_length(batch.column(1)).to_pylist(), 2 << 20):
                ids, edges = own.encode_array(batch.column(1).slice(a, b - a), end_id)
                # Cut where a segment is full; a longer document stands alone.
                for i, j in bounded(np.diff(edges).tolist(), SEGMENT_IDS):
                    if held and size + edges[j] - edges[i] > SEGMENT_IDS:
                        yield flush()
                    held.append((batch.column(0).slice(a + i, j - i), ids[edges[i] : edges[j]], np.diff(edges[i : j + 1])))
                    size += int(edges[j] - edges[i])
        if held:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(segments, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with `base`, the ids of all shards before theirs plus those before them in it."""
    found = spark.read.schema(SEGMENTS).parquet(path)
    totals = found.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    # One row a shard, and write_tokens makes one for each SHARD_BYTES: 4e6 rows for a hundred terabytes, which the planner joins as it sees fit.
    starts = totals.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    return found.join(starts, "shard").withColumn("base", F.col("shard_start") + F.col("first_id"))


def read_documents(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and if asked for the ids (little-endian binary)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for base, data in zip(batch.column(0), batch.column(1), strict=True):
                seg = Segment.from_bytes(data.as_py())
                edges = seg.offsets()
                wide, at = memoryview(seg.ids.astype("<u4")).cast("B"), (4 * edges).tolist()
                columns = [
                    seg.doc_ids,
                    pa.array(edges[:-1] + base.as_py(), pa.int64()),
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array([zlib.crc32(wide[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                ]
                if ids:
                    columns.append(pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * seg.ids.itemsize).astype(np.int32)), pa.py_buffer(seg.ids)]))
                yield pa.RecordBatch.from_arrays(columns, names)

    return read_segments(spark, path).select("base", "data").mapInArrow(rows, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, path, ids=False)
