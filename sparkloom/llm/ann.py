"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and a fast Hadamard transform and assigns each to the nearest
signed axis. Rows are stored once a table; a query probes, in each table, the signed axes nearest to itself, and all rows
found are reranked by exact inner products in double precision.

Only directions are hashed. Rows are also divided into bands of nearly equal norms, and for each query and band the k-th score
found so far tells the least cosine at which a row of the band could still belong to the `k` best. Where the probed buckets may
miss rows of that cosine (MISSED), and always where fewer than `k` were found, the query meets all rows of the band, in blocks.

A bucket or band of any size is split into chunks of rows that meet its queries one by one, so many equal vectors
neither crowd a task nor leave any out. What is nearest within a chunk is a query's `k` best there; nothing else is cut.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
vec_id; vectors of different lengths have no inner product, so each length is searched for itself; a score beyond a double is
infinite; rows of equal vec_id count once, with their best score; a table without rows gives none; other columns are not read. With k
candidates or fewer in all, every one is returned. The rules are the same at every size of the table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, materialize, table

#: Tables, and signed axes that a query probes in each, as a share of all.
TABLES, PROBED = 8, 1 / 32
#: The share of rows of some cosine to a query that its probed buckets may miss; below that cosine, bands are scanned.
MISSED = 0.01
#: Rows of a bucket, or of a scanned band, that meet its queries at once; queries that go to a scanned chunk in one piece.
CHUNK, SCANNED, ASKED = 8192, 2048, 256

#: What is nearest to a query within a chunk.
FOUND = "query_id long, ids binary, scores binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of rows whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    def __init__(self, dims: int, tables: int = TABLES, probed: float = PROBED, seed: int = 11):
        self.dims, self.tables = dims, tables
        self.axes = 1 << max(1, int(dims - 1).bit_length())
        self.probes = min(2 * self.axes, max(1, round(2 * self.axes * probed)))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.axes))

    def _turned(self, x: np.ndarray, number: int) -> np.ndarray:
        for signs in self.signs[number]:
            x = hadamard(x * signs)
        return x

    def _padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.axes))
        out[:, : self.dims] = x / np.abs(x).max(1, keepdims=True)
        return out / np.linalg.norm(x, axis=1, keepdims=True)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each row in each table."""
        x, out = self._padded(x), []
        for t in range(self.tables):
            y = self._turned(x, t)
            axis = np.abs(y).argmax(1)
            out.append(2 * self.axes * t + axis + self.axes * (y[np.arange(len(y)), axis] < 0))
        return np.stack(out, 1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables * probes): the buckets that each query looks into."""
        x, out = self._padded(x), []
        for t in range(self.tables):
            y = self._turned(x, t)
            both = np.concatenate((y, -y), 1)
            out.append(2 * self.axes * t + np.argpartition(-both, self.probes - 1, 1)[:, : self.probes])
        return np.concatenate(out, 1)

    def safe(self, missed: float = MISSED, pairs: int = 1000) -> float:
        """The least cosine from which on no more than that share of rows is missed by the probed buckets, on random pairs; 1 if there is none."""
        rng, least = np.random.default_rng(5), 1.0
        for cosine in np.arange(0.95, 0, -0.05):
            q, u = rng.normal(size=(2, pairs, self.dims))
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            u -= (u * q).sum(1, keepdims=True) * q
            u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
            row, looked = self.buckets(cosine * q + np.sqrt(1 - cosine * cosine) * u), self.probed(q)
            met = (row[:, :, None] == looked.reshape(pairs, self.tables, -1)).any((1, 2))
            if (~met).mean() > missed:
                break
            least = float(cosine)
        return least


class Chunk:
    """Rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.kinds, self.starts, self.counts = np.unique(self.ids, return_index=True, return_counts=True)

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the k nearest ids, each with its best row: query (number), id, score; by query, nearest first.

        A matrix product tells the candidates; their inner products are then summed in the order of components, so equal vectors
        score equally.
        """
        with np.errstate(over="ignore", invalid="ignore"):
            rough = queries @ self.x.T
        rough[np.isnan(rough)] = np.inf  # beyond a double's range on the way: looked at exactly
        best = rough if len(self.kinds) == len(self.ids) else np.maximum.reduceat(rough, self.starts, 1)
        at = np.searchsorted(self.kinds, own)
        mine = np.flatnonzero(self.kinds[np.minimum(at, len(self.kinds) - 1)] == own)
        best = best.copy()
        best[mine, at[mine]] = -np.inf
        edge = np.partition(best, -k, 1)[:, -k] if best.shape[1] > k else np.full(len(queries), -np.inf)
        with np.errstate(invalid="ignore"):
            least = np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), edge)
            query, kind = np.nonzero((best >= least[:, None]) & (best > -np.inf))
            top = best[query, kind]
            top = np.where(np.isfinite(top), top - 1e-9 * (1 + np.abs(top)), top)
        n = self.counts[kind]
        query, top = np.repeat(query, n), np.repeat(top, n)
        row = np.repeat(self.starts[kind] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = rough[query, row] >= top
        query, row = query[near], row[near]
        score = np.empty(len(row))
        for a in range(0, len(row), 1 << 14):
            part = slice(a, a + (1 << 14))
            score[part] = np.cumsum(self.x[row[part]] * queries[query[part]], 1)[:, -1]
        return _nearest(query, self.ids[row], score, k)


def _nearest(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id; an id counts once, with its best score."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))) if len(ids) else [])
    query, ids, score = query[first], ids[first], score[first]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], score[keep]


def nearest(vectors: DataFrame, queries: Column, k: int, tables: int = TABLES, probed: float = PROBED) -> DataFrame:
    """Of vectors (vec_id, embedding): the k nearest of each row for which `queries` holds."""
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    wide = dict(vectors.dtypes)["embedding"]
    kept = "float" if wide == "array<float>" else "double"  # what a vector is kept as on its way
    own = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda v: v.cast(kept)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite
    ).drop("embedding")
    # The norm by its logarithm: the squares of finite components may be beyond a double.
    most = F.array_max(F.transform("v", lambda v: F.abs(v.cast("double"))))
    shares = F.aggregate(F.transform("v", lambda v: v.cast("double") / F.col("most")), F.lit(0.0), lambda t, v: t + v * v)
    own = own.withColumn("most", most).where("most > 0").withColumn("norm2", F.log2("most") + F.log2(shares) / 2).drop("most")
    kinds = own.groupBy(F.size("v").alias("dims")).agg(F.count_if("asks").alias("asking")).orderBy("dims").collect()
    found = [_nearest_of(own.where(F.size("v") == r["dims"]), r["dims"], r["asking"], np.dtype(f"<f{4 if kept == 'float' else 8}"), k, tables, probed) for r in kinds if r["asking"]]
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _nearest_of(own: DataFrame, dims: int, asking: int, dtype: np.dtype, k: int, tables: int, probed: float) -> DataFrame:
    """The same for rows (vec_id, v, asks, norm2) of one length."""
    spark, schema = own.sparkSession, "query_id long, rank int, vec_id long, score double"
    model = CrossPolytope(dims, tables, probed)
    band = F.floor(8 * F.col("norm2")).cast("int").alias("band")  # an eighth of an octave of norms
    rows = own.select("vec_id", "v", "asks", band, "norm2")

    def _vectors(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims).astype(np.float64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = part.column(1).flatten().to_numpy().reshape(-1, dims)
                data, x = np.array([v.tobytes() for v in x], object), x.astype(np.float64)
                ids, asks = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                for asking, at, found in ((False, np.arange(len(x)), model.buckets(x)), (True, np.flatnonzero(asks), model.probed(x[asks]))):
                    if len(at):
                        row = np.repeat(at, found.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found.ravel(), pa.int32()), pa.array(ids[row]), pa.array(np.full(len(row), asking)), pa.array(data[row], pa.binary())],
                            ["bucket", "vec_id", "asks", "v"],
                        )

    hashed = materialize(rows.mapInArrow(spread, "bucket int, vec_id long, asks boolean, v binary"), "hashed-vectors")
    # One row a bucket: tables * signed axes of them, whatever the number of vectors.
    sizes = F.broadcast(hashed.where("NOT asks").groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks")))
    sized = hashed.join(sizes, "bucket")
    stored = sized.where("NOT asks").select("bucket", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "v").toDF("bucket", "chunk", "vec_id", "v")
    asked = sized.where("asks").select("bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "v").toDF("bucket", "chunk", "vec_id", "v")

    def lists(ids: np.ndarray, x: np.ndarray, numbers: np.ndarray, asked_: np.ndarray) -> pa.Table:
        """What is nearest among rows (ids, x) to each query."""
        out, chunk = ([], [], []), Chunk(ids, x) if len(ids) else None
        for a in range(0, len(numbers) if len(ids) else 0, ASKED):
            own_ = numbers[a : a + ASKED]
            query, near, score = chunk.best(asked_[a : a + ASKED], own_, k)
            edges = np.searchsorted(query, np.arange(len(own_) + 1))
            out[0].append(own_)
            out[1].extend(near[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True))
            out[2].extend(score[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True))
        return pa.table({"query_id": pa.array(np.concatenate(out[0]) if out[0] else [], pa.int64()), "ids": pa.array(out[1], pa.binary()), "scores": pa.array(out[2], pa.binary())})

    none = np.zeros(0, np.int64), np.zeros((0, dims))

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return lists(*none, *none)
        return lists(left.column("vec_id").to_numpy(), _vectors(left.column("v")), right.column("vec_id").to_numpy(), _vectors(right.column("v")))

    found = stored.groupBy("bucket", "chunk").cogroup(asked.groupBy("bucket", "chunk")).applyInArrow(rerank, FOUND)
    groups = blocks_for(asking, 256)

    def merge(group: pa.Table) -> pa.Table:
        ids, scores = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("scores", np.float64)))
        count = pc.binary_length(group.column("ids")).to_numpy() // 8
        query, ids, scores = _nearest(np.repeat(group.column("query_id").to_numpy(), count), ids, scores, k)
        rank = 1 + np.arange(len(query)) - np.searchsorted(query, query)
        return pa.table({"query_id": pa.array(query), "rank": pa.array(rank, pa.int32()), "vec_id": pa.array(ids), "score": pa.array(scores)})

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("g").applyInArrow(merge, schema)

    first = materialize(merged(found), "nearest-in-buckets")
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    asking = rows.where("asks").dropDuplicates(["vec_id", "v"]).join(reached, "vec_id", "left")
    # The least norm (its logarithm) at which a row at a safe cosine would score as much: all rows beyond it may be missed.
    reach = F.when(F.col("reached") > 0, F.log2("reached") - F.col("norm2")).otherwise(float("-inf"))
    asking = asking.select("vec_id", "v", reach.alias("reached"))
    least = asking.agg(F.min("reached")).first()[0]
    # One row a band: as many as a double's exponents allow, whatever the number of vectors.
    bands = rows.groupBy("band").agg(F.max("norm2").alias("norm2"), F.count(F.lit(1)).alias("n")).collect()
    safe = np.log2(model.safe()) + 1e-9  # and ties
    unsafe = [(r["band"], safe + r["norm2"], blocks_for(r["n"], SCANNED)) for r in bands if least is not None and least <= safe + r["norm2"]]
    if not unsafe:
        return first

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ASKED):
                part = batch.slice(a, ASKED)
                ids, x, reach = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, dims), part.column(2).to_numpy()
                for band, limit, chunks in unsafe:
                    if (mine := reach <= limit).any():
                        packed = [ids[mine].tobytes()], [x[mine].tobytes()]
                        for chunk in range(chunks):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([band], pa.int32()), pa.array([chunk], pa.int32()), *(pa.array(c, pa.binary()) for c in packed)], ["band", "chunk", "ids", "v"]
                            )

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return lists(*none, *none)
        numbers = np.frombuffer(b"".join(right.column("ids").to_pylist()), np.int64)
        return lists(left.column("vec_id").to_numpy(), _vectors(left.column("v")), numbers, _vectors(right.column("v")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = part.column(3).flatten().to_numpy().reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([v.tobytes() for v in x], pa.binary())], ["band", "chunk", "vec_id", "v"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = ([v.tobytes() for v in batch.column(c).to_numpy()] for c in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], ["query_id", "ids", "scores"])

    sizes = F.broadcast(spark.createDataFrame([(band, chunks) for band, _, chunks in unsafe], "band int, chunks int"))
    held = rows.join(sizes, "band").select("band", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "v")
    held = held.mapInArrow(packed, "band int, chunk int, vec_id long, v binary")
    asks = asking.mapInArrow(ask, "band int, chunk int, ids binary, v binary")
    scanned = held.groupBy("band", "chunk").cogroup(asks.groupBy("band", "chunk")).applyInArrow(scan, FOUND)
    return merged(first.select("query_id", "vec_id", "score").mapInArrow(single, FOUND).unionByName(scanned))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
