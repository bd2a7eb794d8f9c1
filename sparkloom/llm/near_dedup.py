"""MinHash near-dedup: DartMinHash signatures, banded candidates, exact verification, classes.

Documents are weighted sets of runs of five words (a shorter document is the one run of all its words); the weight of a run is
how often it occurs. Two documents are linked if the weighted Jaccard similarity of their sets, the sum of the lesser over the sum
of the greater weights, is at least the threshold, and a class is a connected component of links. Where no run occurs
twice in a document this is the similarity of plain sets.

1. Each text is hashed and signed once, in one pass. Equal sets become one node, so exact copies cost nothing more.
2. Bands of four coordinates give keys; 32 bands miss a pair of similarity 0.8 once in twenty million. Keys are counted
   with partial sums, and each bucket, whatever its size, first names only the links of its nodes to a hub.
3. Candidates are cut down by the weights of the sets (exact) and by a byte of each coordinate (five standard
   deviations below the threshold), then verified on whole texts, each node's best first. Pairs inside a class that has already
   formed are skipped: they cannot change it.
4. Buckets that then still hold several classes are compared whole. One of up to BUCKET nodes names its pairs across classes, a
   constant number a node. In a larger one chunks of nodes meet in one task each with their texts, and every pair across classes that passes
   the filters is verified there; only links leave the task. Nothing is capped, and no group is held by one task.

Defined results: null text and text without words have no set and stand alone; copies are one class whatever their
doc_ids; a class is named by its smallest doc_id (null only if all are null), and the row that has it, the first one of equal
rows, is kept; a table without rows gives none; other columns are not read. Rows are known by their place, so doc_ids may be
null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import bounded
from .common import PLACE, lean, materialize, placed, table
from .dartminhash import signatures
from .graph import merged
from .hashing import mix, runs, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: Nodes of a bucket that names its pairs across classes as rows.
BUCKET = 32
#: Bytes of text, and nodes, of a chunk when larger buckets are compared.
CHUNK_BYTES, CHUNK = 4 << 20, 4096
#: Bytes and number of the texts that are signed or verified at once: a set draws about 900 darts, however small it is.
SLICE_BYTES, SLICE = 512 << 10, 512

_SIGNED = "doc_id long, _file long, _row long, set_a long, set_b long, n long, size long, bands array<bigint>, sketch binary"
_OWNER = np.uint64(0x9E3779B97F4A7C15)


def _grouped(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by owner in which equal hashes of an owner stand side by side, and where a new hash or owner begins."""
    both = mix(h ^ (owner.astype(np.uint64) + np.uint64(1)) * _OWNER)
    order = np.argsort(both)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(owner) and owner.max() < 1 << 16 else np.int64), kind="stable")]
    both = both[order]
    return order, np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.zeros(0, bool)


def _shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's runs: hash, text, and how often it occurs; each once, by text."""
    joined = b"\n".join(texts)
    hashed, start, _ = words(joined)
    edges = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    size = np.diff(edges)
    count = np.maximum(size - SHINGLE + 1, 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) + np.repeat(edges[:-1] - (np.cumsum(count) - count), count)
    hashes, owners = [runs(hashed, SHINGLE)[at]] if len(at) else [], [owner]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(size == n)
        if len(short):
            hashes.append(runs(hashed, n)[edges[short]] ^ np.uint64(n))
            owners.append(short)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order, new = _grouped(h, o)
    first = np.flatnonzero(new)
    return h[order][first], o[order][first], np.diff(np.append(first, len(h)))


def _digests(h: np.ndarray, owner: np.ndarray, count: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of each weighted set, whatever its order, and its weight."""
    out = []
    edges = np.searchsorted(owner, np.arange(sets + 1))
    for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ salt) * count.astype(np.uint64), out=sums[1:])
        out.append((sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
    return out[0], out[1], np.bincount(owner, count, sets).astype(np.int64)


def _encoded(batch: pa.RecordBatch, column: int, a: int, b: int) -> list[bytes]:
    return batch.column(column).slice(a, b - a).cast(pa.binary()).to_pylist()


def _slices(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    lengths = sum((pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for c in columns))
    for a, b in bounded(lengths.tolist(), SLICE_BYTES):
        for i in range(a, b, SLICE):
            yield i, min(b, i + SLICE)


def sign(docs: DataFrame) -> DataFrame:
    """Place, digest, weight, bytes, band keys and coordinate bytes of each text of docs (doc_id, text, _file, _row)."""
    k = BANDS * ROWS
    names = [x.split()[0] for x in _SIGNED.split(", ")]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                texts = _encoded(batch, 1, a, b)
                h, owner, count = _shingles(texts)
                sig = signatures(h, owner, count, b - a, k)
                keys = np.zeros((b - a, BANDS), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(31) + sig[:, r::ROWS])
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
                sketch = (sig >> np.uint64(24)).astype(np.uint8)
                da, db, n = _digests(h, owner, count, b - a)
                own = [batch.column(c).slice(a, b - a) for c in (0, 2, 3)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                sketches = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.arange(0, sketch.size + 1, k, dtype=np.int32)), pa.py_buffer(sketch.tobytes())])
                yield pa.RecordBatch.from_arrays([*own, pa.array(da), pa.array(db), pa.array(n), pa.array(list(map(len, texts)), pa.int64()), bands, sketches], names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *PLACE).mapInArrow(signed, _SIGNED)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, m, hub): the members of each bucket of m > 1 nodes; the hub is the one that a hash with the key puts first."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    # Most keys stand alone; counting has partial sums, and the join may split a key that many nodes share.
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min_by("node", F.xxhash64("node", "key")).alias("hub")).where("m > 1")
    return materialize(keys.join(shared, "key"), "buckets")


def _estimated(pairs: DataFrame, nodes: DataFrame, least: float, similarity: float) -> DataFrame:
    """Pairs (a, b) with the share of equal coordinate bytes, where it is at least `least` and the weights allow the similarity."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                share = (x == y).mean(1)
                keep = np.flatnonzero(share >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(share[keep])], ["a", "b", "est"])

    left = nodes.selectExpr("node AS a", "n AS na", "sketch AS sa")
    right = nodes.selectExpr("node AS b", "n AS nb", "sketch AS sb")
    near = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    return near.select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long, est double")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of wanted (node, _file, _row)."""
    own = docs.select(*PLACE, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return materialize(own.join(wanted, list(PLACE)).select("node", "text"), "texts")


def _similar(hx, ox, cx, hy, oy, cy, pairs: int, similarity: float) -> np.ndarray:
    """Which of the pairs of weighted sets are as similar as asked for."""
    h, o, c = np.concatenate((hx, hy)), np.concatenate((ox, oy)), np.concatenate((cx, cy))
    order, new = _grouped(h, o)
    o, c = o[order], c[order]
    same = np.flatnonzero(~new)  # a hash of both: the other one stands before it
    both = np.bincount(o[same], np.minimum(c[same], c[same - 1]), pairs)
    return np.flatnonzero(both >= similarity * (np.bincount(o, c, pairs) - both))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets are as similar as asked for."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            keep = [i + _similar(*_shingles(_encoded(batch, 2, i, j)), *_shingles(_encoded(batch, 3, i, j)), j - i, similarity) for i, j in _slices(batch.column(2), batch.column(3))]
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(np.concatenate(keep)))

    ta, tb = texts.selectExpr("node AS a", "text AS ta"), texts.selectExpr("node AS b", "text AS tb")
    return pairs.select("a", "b").join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def _resolve(open_pairs: DataFrame, labels: DataFrame, texts: DataFrame, similarity: float, sparing: int = 2) -> DataFrame:
    """Verify pairs (a, b, est) across classes until none is left; the labels then.

    In the first rounds each node brings its best pair, which links most of what belongs together; what is still across
    classes then is verified whole.
    """
    ends_of = ("node AS a", "comp AS ca"), ("node AS b", "comp AS cb")
    for turn in range(sparing + 1):
        la, lb = (labels.selectExpr(*x) for x in ends_of)
        cross = materialize(open_pairs.join(la, "a").join(lb, "b").where("ca <> cb").select("a", "b", "est"), "open-pairs")
        now = cross.select("a", "b")
        if turn < sparing:
            ends = cross.select(F.col("a").alias("node"), "est", "a", "b").unionByName(cross.select(F.col("b").alias("node"), "est", "a", "b"))
            best = ends.groupBy("node").agg(F.max(F.struct("est", "a", "b")).alias("best"))
            now = materialize(best.select("best.a", "best.b").distinct(), "best-pairs")
            open_pairs = cross.join(now, ["a", "b"], "left_anti")
        links = materialize(_verified(now, texts, similarity), "verified")
        if links.limit(1).count():
            labels = merged(labels, links)
        elif not cross.limit(1).count():
            break
    return labels


def _parted(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, comp, m, bytes, hub): the members of the buckets of more than two nodes that hold several classes.

    Labels meet nodes before their keys are written out, and only members of parted buckets leave the join.
    """
    member = labels.join(nodes.select("node", "size", "bands"), "node").select("node", "comp", "size", F.explode("bands").alias("key"))
    several = member.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes"), F.min_by("node", F.xxhash64("node", "key")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    return member.drop("size").join(several.where("m > 2 AND lo <> hi").select("key", "m", "bytes", "hub"), "key")


def _across(large: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, least: float, similarity: float) -> DataFrame:
    """Links (a, b) across classes within larger buckets (key, node, m, bytes); of all links between two classes, some that join them.

    A bucket's members are dealt into chunks, and each two chunks meet in one task with their texts. Every pair across
    classes that the bytes let through is verified there, in the first bucket that its nodes share; links alone leave the task.
    A node meets its class and its text once, with the keys of all its buckets; rows by bucket are written out from there.
    """
    chunks = F.greatest(F.ceil(F.col("m") / F.lit(CHUNK)), F.ceil(F.col("bytes") / F.lit(CHUNK_BYTES))).cast("int")
    owned = large.groupBy("node").agg(F.collect_list(F.struct("key", chunks.alias("chunks"))).alias("buckets"))
    met = owned.join(labels, "node").join(nodes.select("node", "bands", "sketch"), "node").join(texts, "node")
    chunked = met.withColumn("bucket", F.explode("buckets")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("bucket.chunks")).cast("int"))
    rows = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bucket.chunks") - 1))).select(
        F.col("bucket.key").alias("key"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "bands", "sketch", "text"
    )

    def compare(group: pa.Table) -> pa.Table:
        lean()
        group = group.combine_chunks()
        key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
        node, comp, own = (group.column(c).to_numpy() for c in ("node", "comp", "own"))
        if comp.min() == comp.max():  # links of smaller buckets have joined its classes
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        comp = comp.copy()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        bands = pc.list_flatten(group.column("bands")).to_numpy().reshape(len(node), -1)
        band = int(np.argmax(bands[0] == key))
        text = group.column("text").cast(pa.binary())
        sets: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _slices(text):
            h, owner, count = _shingles(text.slice(a, b - a).to_pylist())
            order = np.lexsort((h, owner))
            edges = np.searchsorted(owner, np.arange(1, b - a))
            sets += list(zip(np.split(h[order], edges), np.split(count[order], edges), strict=True))
        size = np.array([c.sum() for _, c in sets])
        sides = (np.flatnonzero(own == i), np.flatnonzero(own == j))
        found = []
        classes, counts = np.unique(comp, return_counts=True)
        largest = comp == classes[np.argmax(counts)]  # as it was when the task began
        for one, other in (sides, sides[::-1])[: 1 + (i != j)]:
            for x in one:
                if largest[x]:
                    continue  # its pairs are met from their other end
                y = other[comp[other] != comp[x]]
                y = y[np.minimum(size[y], size[x]) >= similarity * np.maximum(size[y], size[x])]
                y = y[(sketch[y] == sketch[x]).mean(1) >= least]
                y = y[np.argmax(bands[y] == bands[x], 1) == band]
                if not len(y):
                    continue
                h, count = sets[x]
                every, weight = (np.concatenate([sets[k][c] for k in y]) for c in (0, 1))
                at = np.minimum(np.searchsorted(h, every), len(h) - 1)
                lesser = np.where(h[at] == every, np.minimum(count[at], weight), 0)
                both = np.add.reduceat(lesser, np.cumsum([0, *(len(sets[k][0]) for k in y[:-1])]))
                linked = y[both >= similarity * (size[y] + size[x] - both)]
                for c, k in zip(*np.unique(comp[linked], return_index=True), strict=True):
                    found.append((min(node[x], node[linked[k]]), max(node[x], node[linked[k]])))
                    comp[comp == c] = comp[x]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, place: bool = False) -> DataFrame:
    """Of docs (doc_id, text): doc_id, class_id, class_size, kept, and if asked for the places of the rows."""
    slack = 5 * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5
    least = similarity - slack
    docs = placed(docs, ("doc_id", "text"))
    signed = materialize(sign(docs).withColumn("uid", F.monotonically_increasing_id()), "signed")
    sets = signed.where("n > 0").groupBy("set_a", "set_b").agg(F.min("uid").alias("node"))
    members = materialize(
        signed.select("uid", "doc_id", *PLACE, "n", "set_a", "set_b").join(sets, ["set_a", "set_b"], "left").withColumn("node", F.coalesce("node", "uid")).drop("set_a", "set_b"), "members"
    )
    heads = members.where("n > 0 AND uid = node").select("uid", "node")
    nodes = materialize(heads.join(signed.select("uid", *PLACE, "n", "size", "bands", "sketch"), "uid").drop("uid"), "nodes")
    buckets = _buckets(nodes)
    spokes = buckets.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near = materialize(_estimated(spokes, nodes, least, similarity), "near-pairs")
    # Beyond two nodes there are pairs without the hub, so these may be compared later.
    touched = near.selectExpr("a AS node").unionByName(near.selectExpr("b AS node")).unionByName(buckets.where("m > 2").select("node")).distinct()
    labels = materialize(touched.withColumn("comp", F.col("node")), "labels")
    texts = _texts(docs, nodes.join(labels.select("node"), "node").select("node", *PLACE))
    labels = _resolve(near, labels, texts, similarity)
    parted = materialize(_parted(nodes, labels), "parted-buckets")
    if parted.limit(1).count():
        small = parted.where((F.col("m") <= BUCKET) & (F.col("node") != F.col("hub"))).select("key", "node", "comp")
        left, right = small.selectExpr("key", "node AS a", "comp AS ca"), small.selectExpr("key", "node AS b", "comp AS cb")
        inside = left.join(right, "key").where("a < b AND ca <> cb").select("a", "b").distinct()
        labels = _resolve(materialize(_estimated(inside, nodes, least, similarity), "near-pairs"), labels, texts, similarity)
        links = materialize(_across(parted.where(F.col("m") > BUCKET), labels, nodes, texts, least, similarity), "across")
        if links.limit(1).count():
            labels = merged(labels, links)
    joined = members.join(labels, "node", "left").select("uid", "doc_id", *PLACE, F.coalesce("comp", "node").alias("comp"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    classes = joined.groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return joined.join(classes, "comp").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("first.uid")).alias("kept"), *(PLACE if place else ())
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
