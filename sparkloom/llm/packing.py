"""Bulk-synchronous best-fit packing of token sequences into bins of one capacity.

Pieces are range-sorted by length, longest first, so each piece has a global rank and pieces of one length are one
run of ranks. Gaps are kept the same way, as runs of bins with equal room: equal lengths, and equal rooms, can take each other's
place, so a sweep over runs matches exactly what a sweep over single rows would. Runs of pieces, runs of gaps and placements are
rows of a table in the shared folder that each round reads and writes. A round

1. deals both by ranges of sizes and sweeps each range from long to short, all ranges side by side, until it places no more: a
   piece's successor is the smallest room left that holds it. Pieces without one in their own range meet what is left in ever
   wider ranges, up to the whole;
2. resolves conflicts by rank: the k-th piece of a run gets the k-th bin of the run of gaps, and each bin takes at
   most one piece a sweep;
3. opens bins, seeded with the longest pieces left over, as many as are needed at least: for the length beyond all
   room left, or for the pieces that no gap holds;
4. updates the gaps, which go to the ranges of their new rooms, and the next round begins until no piece is left.

Pieces of a length are one run at any time, `capacity` of them at most, and a sweep adds two runs of gaps at most for each. No row of
the state comes to the driver. Placements find their pieces by rank, in the range partitions that hold both.

Defined results: null text is the empty text, one piece of its end id alone; equal or null doc_ids are separate
documents; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import bounded
from .common import blocks_for, lean, materialize, table
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Pieces in a range partition, about.
PARTITION_PIECES = 1 << 16
#: Sizes of a range in which a sweep begins, and how many ranges are swept together next.
WIDTH, RANGES = 1024, 4


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode docs (doc_id, text), end each with end_id, cut what is longer than capacity."""
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        own = encoder(tokenizer)
        for batch in batches:
            for a, b in bounded(pc.binary_length(batch.column(1)).to_pylist(), 2 << 20):
                ids, edges = own.encode_array(batch.column(1).slice(a, b - a), end_id)
                size = np.diff(edges)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(size[doc] - start, capacity)
                wide, at = memoryview(ids.astype("<u4")).cast("B"), 4 * (edges[doc] + start)
                crc = [zlib.crc32(wide[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                own_ids = batch.column(0).slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([own_ids, pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], schema=kinds)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(cut, PIECES)


#: Rows of the state of packing: of a kind, `n` pieces of length `size` from rank `first` on, or `n` bins with room `size` from
#: bin `first` on, or placements of `n` pieces of length `size` from rank `first` on in the bins from `bin` on at `offset`, or
#: the number `n` of bins opened so far.
STATE = "kind int, size int, first long, n long, bin long, offset int"
PIECE, GAP, PLACED, BINS = range(4)

Run = tuple[int, int, int]  # size, first, n


def sweep(pieces: list[Run], gaps: list[Run], capacity: int) -> tuple[list[tuple], list[Run], list[Run], list[Run]]:
    """One sweep over runs, from long to short: placements, the bins that took a piece, pieces left, bins left.

    A piece's successor is the smallest room left that holds it; the k-th piece of a run takes the k-th bin of the run of gaps.
    """
    gaps = sorted(gaps, key=lambda x: (-x[0], x[1]))
    placed, filled, left, stack, at = [], [], [], [], 0  # stack: gaps that the sweep has passed; the smallest room is on top
    for size, first, n in sorted(pieces, key=lambda x: (-x[0], x[1])):
        while at < len(gaps) and gaps[at][0] >= size:
            stack.append(gaps[at])
            at += 1
        while n and stack:
            room, bin_, have = stack.pop()
            take = min(n, have)
            placed.append((PLACED, size, first, take, bin_, capacity - room))
            if room > size:
                filled.append((room - size, bin_, take))
            first, n = first + take, n - take
            if have > take:
                stack.append((room, bin_ + take, have - take))
        if n:
            left.append((size, first, n))
    return placed, filled, left, [*stack, *gaps[at:]]


def sweep_range(pieces: list[Run], gaps: list[Run], low: int, high: int, capacity: int) -> tuple[list[tuple], list[Run], list[Run]]:
    """Sweeps over one range of sizes, until none places a piece: placements, pieces left, bins left, be their room in the range or not."""
    placed, away = [], []
    while True:
        found, filled, pieces, gaps = sweep(pieces, gaps, capacity)
        if not found:
            return placed, pieces, gaps + away
        placed += found
        gaps += [g for g in filled if low <= g[0] <= high]
        away += [g for g in filled if not low <= g[0] <= high]


def open_bins(pieces: list[Run], gaps: list[Run], bins: int, capacity: int) -> tuple[list[tuple], list[Run], list[Run], int]:
    """Open the bins that are needed at least, seeded with the longest pieces: placements, pieces left, new gaps, bins in all.

    They are needed for the length beyond all room left, or for pieces that no gap holds.
    """
    room, most = sum(size * n for size, _, n in gaps), max((size for size, _, _ in gaps), default=0)
    length, homeless = sum(size * n for size, _, n in pieces), sum(size * n for size, _, n in pieces if size > most)
    need = max(-(-(length - room) // capacity), -(-homeless // capacity), 0)
    placed, left, opened = [], [], []
    for size, first, n in sorted(pieces, key=lambda x: (-x[0], x[1])):
        take = min(need, n)
        if take:
            placed.append((PLACED, size, first, take, bins, 0))
            if size < capacity:
                opened.append((capacity - size, bins, take))
            bins, need = bins + take, need - take
        if n > take:
            left.append((size, first + take, n - take))
    return placed, left, opened, bins


def _swept(state: DataFrame, width: int, capacity: int) -> DataFrame:
    """Each range of `width` sizes swept, side by side; with the whole in one range, bins are opened as well."""
    names = [x.split()[0] for x in STATE.split(", ")]
    kinds = pa.schema(zip(names, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()], strict=True))

    def swept(key: tuple, group: pa.Table) -> pa.Table:
        kind, low = group.column("kind").to_numpy(), key[0].as_py() * width + 1
        runs = list(zip(*(group.column(c).to_pylist() for c in ("size", "first", "n")), strict=True))
        pieces, gaps, bins = ([r for r, k in zip(runs, kind, strict=True) if k == what] for what in (PIECE, GAP, BINS))
        out = []
        out, pieces, gaps = sweep_range(pieces, gaps, low, low + width - 1, capacity)
        if width < capacity:
            out += [(BINS, *b, None, None) for b in bins]
        else:
            more, pieces, opened, count = open_bins(pieces, gaps, sum(n for _, _, n in bins), capacity)
            out, gaps = [*out, *more, (BINS, 1, 0, count, None, None)], gaps + opened
        out += [(PIECE, *x, None, None) for x in pieces] + [(GAP, *x, None, None) for x in gaps]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        done = group.filter(pa.array(kind == PLACED)).select(names)
        return pa.concat_tables([done.cast(kinds), pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)])

    return state.groupBy(F.floor((F.col("size") - 1) / F.lit(width)).cast("int").alias("range")).applyInArrow(swept, STATE)


def best_fit(runs: DataFrame, capacity: int, width: int = 0) -> DataFrame:
    """Placements (size, first, n, bin, offset) of runs of pieces (size, first, n), `first` being the rank of a run's first piece.

    The state is a table that each round reads and writes anew: its sweeps go range by range of sizes; what finds no gap in
    its own range meets the gaps left in ranges RANGES times as wide, and so on up to the whole, where bins are opened.
    """
    none = F.lit(None)
    state = runs.select(F.lit(PIECE).alias("kind"), F.col("size").cast("int").alias("size"), "first", "n", none.cast("long").alias("bin"), none.cast("int").alias("offset"))
    rounds = []
    while True:
        wide = width or WIDTH
        while True:
            state = _swept(state, wide, capacity)
            if wide >= capacity:
                break
            wide *= RANGES
        rounds.append(materialize(state, "packing-round"))
        if not rounds[-1].where(F.col("kind") == PIECE).limit(1).count():
            break
        state = rounds[-1].where(F.col("kind") != PLACED)
    paths = [path for r in rounds for path in r.inputFiles()]
    return runs.sparkSession.read.schema(STATE).parquet(*paths).where(F.col("kind") == PLACED).drop("kind")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of 1 to capacity."""
    columns = pieces.columns
    rows = materialize(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    # One row a length: `capacity` of them at most, whatever the number of pieces.
    counts = materialize(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placements = best_fit(counts.select(F.col("length").alias("size"), before.alias("first"), "n"), capacity)
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = blocks_for(total, PARTITION_PIECES)
    order = [F.col("length").desc(), F.col("_uid").asc()]
    ranked = materialize(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop("_uid"),
        "ranked-pieces",
    )
    # monotonically_increasing_id: the partition above bit 33, the row in it below.
    part, row = F.shiftrightunsigned("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    # One row a range partition. `_from` is the rank of its first piece.
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_from"), "n")
    # A placement goes to each partition whose ranks it overlaps: cut at multiples of PARTITION_PIECES, both meet without comparing all.
    cell = lambda rank: F.floor(rank / F.lit(PARTITION_PIECES)).cast("long")
    cut = placements.withColumn("_cell", F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.col("n") - 1))))
    spans = starts.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_from") + F.col("n") - 1)))).select("_part", "_cell", "_from", F.col("n").alias("_n"))
    own = cut.join(spans, "_cell").where((F.col("first") < F.col("_from") + F.col("_n")) & (F.col("first") + F.col("n") > F.col("_from")))
    own = own.select("_part", "_from", "first", "bin", "offset").distinct()
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    kinds = to_arrow_schema(schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return kinds.empty_table()
        first, bin_, offset = (right.column(c).to_numpy() for c in ("first", "bin", "offset"))
        order = np.argsort(first)
        first, bin_, offset = first[order], bin_[order], offset[order].astype(np.int64)
        rank = left.column("_row").to_numpy() + right.column("_from")[0].as_py()
        at = np.searchsorted(first, rank, "right") - 1
        placed = [pa.chunked_array([pa.array(x)]) for x in (bin_[at] + rank - first[at], offset[at])]
        return pa.Table.from_arrays([*(left.column(c) for c in columns), *placed], schema=kinds)

    numbered = ranked.select(*columns, part.alias("_part"), row.alias("_row"))
    return numbered.groupBy("_part").cogroup(own.groupBy("_part")).applyInArrow(look_up, fields)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
