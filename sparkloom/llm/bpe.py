"""BPE encoding and decoding over a distinct-word table.

Spark splits texts into words. Each block of documents, as they lie in their files, keeps its words as numbers into the list
of its distinct words, and names each distinct word once, dealt into parts by a hash of the word; so all mentions of a word meet in one
part, which encodes it once. A block names a part's words in one message, and the number of parts is bounded, so messages
grow with the blocks. A part is read as a stream: what it holds are the words it knows. The ids return to the blocks in the
order of their lists, are joined back by position, and the text is decoded again through a join of the ids with the id-to-piece
table, which is as large as the vocabulary and never larger.

Defined results: null text is the empty text with no ids; equal or null doc_ids are separate rows; a table without
rows gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import block_batches, bounded, expand, squeeze
from .common import blocks_for, file_rows, lean, shuffle_partitions, source_bytes, table
from .hashing import spans
from .tokens import Encoder, encoder, gathered

#: Parts of the distinct words: one for each PART_BYTES of input files, and PARTS at most, so that a block's messages stay few.
PART_BYTES, PARTS = 4 << 20, 2048

_PACK = "block long, docs binary, counts binary, codes binary, lengths binary, words binary"


def _squeezed(strings: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and bytes of an array of strings without nulls."""
    strings = pa.concat_arrays([strings])
    edges = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1)
    data = bytes(strings.buffers()[2])[: edges[-1]] if edges[-1] else b""
    return squeeze(np.diff(edges).astype(np.int32)), zstandard.ZstdCompressor(level=1).compress(data)


def _strings(lengths: bytes, data: bytes) -> pa.Array:
    edges = np.concatenate(([0], np.cumsum(expand(lengths, np.int32), dtype=np.int64))).astype(np.int32)
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(zstandard.ZstdDecompressor().decompress(data)))


def _dealt(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct words by part, and where each part begins in it."""
    edges = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and edges[-1] else np.zeros(0, np.uint8)
    part = (spans(raw, edges[:-1], edges[1:]) % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Of docs (doc_id, text): doc_id, ids as binary, decoded text as binary, by block.

    Ids are little-endian, two bytes wide if the vocabulary has at most 65,536, else four.
    """
    return _coded(docs, path, "doc_id long, ids binary, decoded binary", _ids_and_text)


def _ids_and_text(own: Encoder, ids: np.ndarray, edges: np.ndarray, decoded: list[bytes]) -> list[pa.Array]:
    return [pa.array([ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()), pa.array(decoded, pa.binary())]


def _digests(own: Encoder, ids: np.ndarray, edges: np.ndarray, decoded: list[bytes]) -> list[pa.Array]:
    said, at = _joined(own.decimals(), ids, edges)
    listed = [hashlib.sha256(said[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]  # without the last comma
    return [pa.array(np.diff(edges), pa.int64()), pa.array(listed, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]


def _joined(of_id: pa.Array, ids: np.ndarray, edges: np.ndarray) -> tuple[memoryview, list[int]]:
    """Ids joined with the table of what stands for each: the bytes of all, and where those of each text begin."""
    found = of_id.take(pa.array(ids))
    ends = np.frombuffer(found.buffers()[1], np.int32, len(ids) + 1)
    return memoryview(found.buffers()[2] if len(ids) and ends[-1] else b""), ends[edges].tolist()


def _coded(docs: DataFrame, path: str, schema: str, finish) -> DataFrame:
    source = file_rows(docs, ("doc_id", "text"))
    parts = min(PARTS, blocks_for(source_bytes(source), PART_BYTES))
    names, kinds = [x.split()[0] for x in schema.split(", ")], _arrow(schema)
    split = encoder(path).spark_words(F.coalesce(F.col("text"), F.lit("")))
    rows = source.select(F.col("doc_id").cast("long"), split.alias("words"))

    most = blocks.BLOCK_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for block, held in block_batches(batches, most):
            lists = held.column("words").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            coded = lists.flatten().dictionary_encode()
            counts = np.diff(lists.offsets.to_numpy())
            lengths, words = _squeezed(coded.dictionary)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
                out.write_table(held.select(["doc_id"]))
            row = [[block], [sink.getvalue().to_pybytes()], [squeeze(counts.astype(np.int32))], [squeeze(coded.indices.to_numpy().astype(np.int32))], [lengths], [words]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], [x.split()[0] for x in _PACK.split(", ")])

    def name(group: pa.Table) -> pa.Table:
        words = _strings(*(group.column(c)[0].as_py() for c in ("lengths", "words")))
        order, begin = _dealt(words, parts)
        listed, full = words.take(pa.array(order)), np.flatnonzero(np.diff(begin))
        blobs = [_squeezed(listed.slice(begin[p], begin[p + 1] - begin[p])) for p in full]
        return pa.table({
            "part": pa.array(full, pa.int32()),
            "block": pa.array(np.full(len(full), group.column("block")[0].as_py()), pa.int64()),
            "lengths": pa.array([x[0] for x in blobs], pa.binary()),
            "words": pa.array([x[1] for x in blobs], pa.binary()),
        })

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        own = encoder(path)
        for batch in batches:
            blobs = list(zip(batch.column("lengths").to_pylist(), batch.column("words").to_pylist(), strict=True))
            for a, b in bounded([len(x) + 4 * len(y) for x, y in blobs], 4 << 20):
                lists = [_strings(*x) for x in blobs[a:b]]
                ids, edges = own.encode_array(pa.concat_arrays(lists))
                sizes, at = np.diff(edges), np.cumsum([0, *map(len, lists)])
                yield pa.RecordBatch.from_arrays([
                    batch.column("block").slice(a, b - a),
                    batch.column("part").slice(a, b - a),
                    pa.array([squeeze(sizes[i:j].astype(np.uint32)) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    pa.array([squeeze(ids[edges[i] : edges[j]]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                ], ["block", "part", "sizes", "ids"])

    def finished(group: pa.Table, answers: pa.Table) -> pa.Table:
        own = encoder(path)
        if not group.num_rows:
            return kinds.empty_table()
        of = {c: group.column(c)[0].as_py() for c in ("docs", "counts", "codes", "lengths", "words")}
        order, begin = _dealt(_strings(of["lengths"], of["words"]), parts)
        size = np.zeros(len(order), np.int64)
        said = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "sizes", "ids")), strict=True))
        for part, sizes, _ in said:
            size[order[begin[part] : begin[part + 1]]] = expand(sizes, np.uint32)
        data = np.concatenate([expand(ids, own.dtype) for *_, ids in said]) if said else np.zeros(0, own.dtype)
        start = np.empty(len(order), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        doc_ids = pa.ipc.open_stream(of["docs"]).read_all().column("doc_id").combine_chunks()
        counts, codes, out = expand(of["counts"], np.int32), expand(of["codes"], np.int32), []
        at = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        for a, b in bounded(counts.tolist(), 1 << 18):
            code = codes[at[a] : at[b]]
            ids, ends = gathered(data, start[code], size[code])
            edges = ends[at[a : b + 1] - at[a]]
            raw, cuts = _joined(own.pieces(), ids, edges)
            decoded = [_lossy(raw[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            out.append(pa.Table.from_arrays([doc_ids.slice(a, b - a), *finish(own, ids, edges, decoded)], schema=kinds))
        return pa.concat_tables(out) if out else kinds.empty_table()

    packs = rows.mapInArrow(pack, _PACK)
    found = packs.groupBy("block").applyInArrow(name, "part int, block long, lengths binary, words binary")
    dealt = found.repartition(shuffle_partitions(docs.sparkSession), "part").sortWithinPartitions("part")
    coded = dealt.mapInArrow(encode, "block long, part int, sizes binary, ids binary")
    return packs.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(finished, schema)


def _lossy(raw: memoryview) -> bytes:
    """Bytes as the library's decoder returns them: what is no UTF-8 is replaced."""
    data = bytes(raw)
    try:
        data.decode()
    except UnicodeDecodeError:
        data = data.decode("utf-8", "replace").encode()
    return data


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return _coded(docs, public_tokenizers.path("byte_bpe_50k.json"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)
