"""Documents in blocks as they lie in their files, packed and compressed before the exchange.

Several operators need a block's documents more than once: to tell the rest of the corpus what is in them, and
again when the answers have come back. The packed exchange is built once and reused by every later stage of the
plan, and answers travel as bits or ids, never as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_rows, lean

#: Bytes of text that a block holds at most, but for a longer text, which stands alone.
BLOCK_BYTES = 12 << 20

_OPTIONS = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))


def _pack(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as writer:
        writer.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpack(packs: pa.ChunkedArray) -> pa.Table | None:
    """The documents of all packs of a block, or None if there is none."""
    tables = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in packs]
    return pa.concat_tables(tables) if tables else None


def pack_blocks(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(block, pack) rows of docs (doc_id, text, carry): a block is what a task reads next, up to BLOCK_BYTES of text.

    Rows are dealt as they lie in their files, whatever their doc_ids, and a task that runs again makes the same blocks.
    """

    most = BLOCK_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for block, rows in block_batches(batches, most):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "pack": pa.array([_pack(rows)], pa.binary())})

    rows = file_rows(docs, ("doc_id", "text", *carry)).select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(F.col(c).alias(f"_carry_{c}") for c in carry)
    )
    return rows.mapInArrow(pack, "block long, pack binary")


def block_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """The blocks of a task: their numbers and rows. The second column is the one whose bytes count, up to `most` in a block."""
    first, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        nbytes = pc.binary_length(batch.column(1)).to_pylist() if pa.types.is_string(batch.column(1).type) else [batch.nbytes // max(1, batch.num_rows)] * batch.num_rows
        start = 0
        for i, n in enumerate(nbytes):
            if size and size + n > most:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield first + count, pa.Table.from_batches(held)
                start, count, held, size = i, count + 1, [], 0
            size += n + 1
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield first + count, pa.Table.from_batches(held)


def squeeze(array: np.ndarray) -> bytes:
    """An array as compressed byte planes: planes of small or sorted numbers shrink to almost nothing."""
    raw = np.ascontiguousarray(array)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes() if len(raw) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def expand(data: bytes, dtype) -> np.ndarray:
    planes = zstandard.ZstdDecompressor().decompress(data)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def squeeze_bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def expand_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=n).astype(bool)


def bounded(lengths, most: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive items whose lengths add up to most at most; a longer item stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
