"""Substring dedup by difference-cover anchors.

A window is WINDOW consecutive words of a document. A word goes if it lies in a window whose words also start
somewhere in a document with a smaller doc_id; windows are judged on the input.

Positions are covered modulo PERIOD by a difference cover: for any two positions i and j there is a shift below PERIOD
that moves both onto cover positions. So two equal windows share an aligned anchor, the hash of the
WINDOW - PERIOD + 1 words at that shift, though only 6 of 31 positions are ever hashed. Then

1. each block of documents, as they lie in their files, names the anchors it holds as rows, once each; the numbers of those that
   occur in a single document of the corpus only stay out of what returns;
2. anchors that occur elsewhere extend to the windows around them: only these windows are hashed in full (128 bits),
   and each block names each of them once with the smallest doc_id it has;
3. the numbers of the windows that a smaller doc_id holds elsewhere return.

No pair of documents is ever formed, and rows that travel grow with the anchors and windows: a group of any number of copies costs
what its documents cost, and a passage of a third of all documents is named once by each block.

Defined results: null text has no words; rows with equal doc_id are not smaller than each other; a null doc_id is
larger than every number; a document of fewer than WINDOW words keeps them all; a table without rows gives none; other
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import bounded, pack_blocks, unpack
from .common import table
from .hashing import runs, words

WINDOW = 50

#: A perfect difference cover, each difference modulo 31 occurs.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

_NO_ID = np.iinfo(np.int64).max
_COVERED = np.isin(np.arange(PERIOD), COVER)


class _Block:
    """The documents of a block: words, anchors and windows in the order of doc_id."""

    def __init__(self, packs: pa.ChunkedArray, window: int):
        rows = self.rows = unpack(packs)
        self.doc_ids: list = []
        self.texts: list[bytes] = []
        if rows is not None:
            ids = rows.column("doc_id").to_pylist()
            texts = rows.column("text")
            order = sorted(range(len(ids)), key=lambda i: _NO_ID if ids[i] is None else ids[i])
            self.rows = rows.take(pa.array(order, pa.int64()))
            for i in order:
                self.doc_ids.append(ids[i])
                self.texts.append(texts[i].as_py().encode())
        self.window = window
        self.anchor_words = window - PERIOD + 1

    @functools.cached_property
    def slices(self) -> list[tuple]:
        """(first document, texts, word hashes, word bounds by document, anchors) of about a megabyte of text each, worked out once."""
        out = []
        for a, b in bounded([len(t) + 1 for t in self.texts], 1 << 20):
            hashed, start, _ = words(b"\n".join(self.texts[a:b]))
            bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in self.texts[a:b])]))
            out.append((a, self.texts[a:b], hashed, bounds, self._anchors(hashed, bounds)))
        return out

    def _anchors(self, hashed: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the anchors of a slice, their hashes and documents (numbers in the slice)."""
        place, doc = _places(bounds, self.window)
        fits = _COVERED[(place - bounds[doc]) % PERIOD] & (place + self.anchor_words <= bounds[doc + 1])
        place, doc = place[fits], doc[fits]
        return place, runs(hashed, self.anchor_words)[place] if len(place) else np.zeros(0, np.uint64), doc


def _places(bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All word positions of documents of at least so many words, and the documents."""
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), np.where(size >= least, size, 0))
    full = np.flatnonzero(size >= least)
    if not len(full):
        return np.zeros(0, np.int64), doc
    return np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in full]), doc


def _first_of(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def _block_anchors(block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor hashes of a block, sorted, and whether several of its documents hold one."""
    if not block.slices:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.concatenate([anchors[1] for *_, anchors in block.slices])
    d = np.concatenate([anchors[2] + first for first, *_, anchors in block.slices])
    order = np.argsort(h)
    h, d = h[order], d[order]
    at = _first_of(h) if len(h) else np.zeros(0, np.int64)
    return h[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(h) else np.zeros(0, bool)


def _block_windows(block: _Block, shared: np.ndarray) -> list[tuple]:
    """For each slice: its windows around shared anchors as (first document, texts, bounds, document, place, 128-bit hash)."""
    out = []
    for first, texts, hashed, bounds, (place, h, doc) in block.slices:
        hit = np.zeros(len(h), bool)
        if len(shared) and len(h):
            at = np.searchsorted(shared, h)
            hit = shared[np.minimum(at, len(shared) - 1)] == h
        # An anchor at p lies, at a shift below PERIOD, in the windows from p - PERIOD + 1 to p.
        near = _covered(np.maximum(place[hit] - PERIOD + 1, bounds[doc[hit]]), place[hit] + 1, len(hashed))
        at = np.flatnonzero(near)
        of = np.searchsorted(bounds, at, "right") - 1
        fits = at + block.window <= bounds[of + 1]
        at, of = at[fits], of[fits]
        wide = np.zeros((2, len(at)), np.uint64)
        if len(at):
            wide[0], wide[1] = runs(hashed, block.window, 0)[at], runs(hashed, block.window, 1)[at]
        out.append((first, texts, bounds, of, at, wide))
    return out


def _covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the stretches."""
    return np.cumsum(np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1])[:-1] > 0


def _distinct_windows(block: _Block, found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of a block in order (both halves), the smallest id of each, and which of them each window is."""
    number = _numbers(block)
    a, b = np.concatenate([x[-1] for x in found] or [np.zeros((2, 0), np.uint64)], 1)
    ids = np.concatenate([number[of + first] for first, _, _, of, _, _ in found] or [np.zeros(0, np.int64)])
    order = np.lexsort((ids, b, a))
    a, b, ids = a[order], b[order], ids[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return np.stack((a[new], b[new])), ids[new], which


def _shared_anchors(block: _Block, answers: pa.Table) -> np.ndarray:
    """Of a block's sorted anchors those whose numbers have come back."""
    return _block_anchors(block)[0][np.sort(answers.column("at").to_numpy())]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256; if asked for, the kept text; the columns of carry.

    The digest is of the kept words joined by one space; so is the kept text, but a text that loses nothing stays as it is.
    """
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    packs = pack_blocks(docs, carry)

    def name_anchors(key: tuple, group: pa.Table) -> pa.Table:
        hashes, several = _block_anchors(_Block(group.column("pack"), window))
        n = len(hashes)
        return pa.table({"hash": pa.array(hashes.view(np.int64)), "block": pa.array(np.full(n, key[0].as_py()), pa.int64()), "at": pa.array(np.arange(n), pa.int32()), "several": pa.array(several)})

    def name_windows(key: tuple, group: pa.Table, anchors: pa.Table) -> pa.Table:
        block = _Block(group.column("pack"), window)
        (first, second), ids, _ = _distinct_windows(block, _block_windows(block, _shared_anchors(block, anchors)))
        n = len(ids)
        return pa.table({
            "a": pa.array(first.view(np.int64)),
            "b": pa.array(second.view(np.int64)),
            "id": pa.array(ids),
            "block": pa.array(np.full(n, key[0].as_py()), pa.int64()),
            "at": pa.array(np.arange(n), pa.int32()),
        })

    def remove(group: pa.Table, anchors: pa.Table, windows: pa.Table) -> pa.Table:
        block = _Block(group.column("pack"), window)
        found = _block_windows(block, _shared_anchors(block, anchors))
        _, ids, which = _distinct_windows(block, found)
        elsewhere = np.zeros(len(ids), bool)
        elsewhere[windows.column("at").to_numpy()] = True
        out: list[tuple] = []
        number, done = _numbers(block), 0
        for first, texts, bounds, of, at, _ in found:
            own = which[done : done + len(at)]
            done += len(at)
            hit = at[elsewhere[own] | (ids[own] < number[of + first])]
            gone = _covered(hit, hit + window, int(bounds[-1]))
            for i, data in enumerate(texts):
                lost = gone[bounds[i] : bounds[i + 1]]
                kept = data.split()
                if lost.any():
                    kept = list(compress(kept, (~lost).tolist()))
                joined = b" ".join(kept)
                row = (block.doc_ids[first + i], len(lost), int(lost.sum()), hashlib.sha256(joined).hexdigest())
                out.append((*row, (joined if lost.any() else data).decode()) if text else row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 + text]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        # The rows of out are in the order of block.rows; a group without documents has no rows.
        arrays += [block.rows.column(f"_carry_{c}") if out else pa.array([], carried.field(c).type) for c in carry]
        return pa.Table.from_arrays(arrays, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text
    names = [*(x.split()[0] for x in schema.split(", ")), *carry]
    carried = to_arrow_schema(docs.select(*carry).schema)
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    # A block names an anchor or a window once, so these windows hold a row a block at most; Spark sorts them and spills.
    anchors = packs.groupBy("block").applyInArrow(name_anchors, "hash long, block long, at int, several boolean")
    of_hash = W.partitionBy("hash")
    met = anchors.select("block", "at", F.count(F.lit(1)).over(of_hash).alias("n"), F.max("several").over(of_hash).alias("several"))
    shared_anchors = met.where("n > 1 OR several").select("block", "at")
    found = packs.groupBy("block").cogroup(shared_anchors.groupBy("block")).applyInArrow(name_windows, "a long, b long, id long, block long, at int")
    least = F.min("id").over(W.partitionBy("a", "b"))
    smaller = found.select("block", "at", (least < F.col("id")).alias("smaller")).where("smaller").select("block", "at")

    # Both kinds of answers go to their block together.
    both = shared_anchors.select("block", "at", F.lit(True).alias("of_anchors")).unionByName(smaller.select("block", "at", F.lit(False).alias("of_anchors")))

    def remove_both(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        of_anchors = answers.column("of_anchors").to_numpy(zero_copy_only=False).astype(bool)
        return remove(group, answers.filter(pa.array(of_anchors)), answers.filter(pa.array(~of_anchors)))

    return packs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(remove_both, schema)


def _numbers(block: _Block) -> np.ndarray:
    return np.array([_NO_ID if d is None else d for d in block.doc_ids], np.int64)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
