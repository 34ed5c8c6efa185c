"""Vectors in numbers: moments, principal components and nearest neighbours of many queries, in blocks of Arrow batches.

Vectors that are null, of another dimension than most, or hold a null or non-finite component take no part. What reaches the driver is bounded by the dimension: a mean and
a matrix of its square; queries and vectors never do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasstally.errors import InputError

#: Queries and vectors of a block; bytes of queries that go to every task, beyond which blocks meet in a shuffle; results of a task that are held.
QUERY_BLOCK, VECTOR_BLOCK, BROADCAST_BYTES, HELD = 1_024, 2_048, 64_000_000, 2_000_000
#: Decimals that decide the order of scores, so that the order of additions doesn't.
DECIMALS = 12


def dimension(vectors: DataFrame, vector: str = "embedding") -> int:
    """The most frequent number of components, the larger of two; 0 without vectors."""
    sizes = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()
    return found["d"] or 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a column as rows of doubles, and their positions."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), d), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    rows = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
    whole = np.isfinite(rows).all(1) if d else np.zeros(len(at), bool)
    return rows[whole], at[whole]


def _summed(partial: DataFrame, *keys: str) -> DataFrame:
    """Sums of arrays by keys and place, from a row for each task."""
    return partial.select(*keys, F.posexplode("sums").alias("at", "x")).groupBy(*keys, "at").agg(F.sum("x").alias("x"))


def mean(vectors: DataFrame, vector: str = "embedding", d: int | None = None) -> DataFrame:
    """Rows (i, mean, n) for each component."""
    d = dimension(vectors, vector) if d is None else d

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(d), 0
        for batch in batches:
            rows, _ = matrix(batch.column(0), d)
            sums, n = sums + rows.sum(0), n + len(rows)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[*sums.tolist(), float(n)]])], ["sums"])

    total = _summed(vectors.select(vector).mapInArrow(run, "sums array<double>")).withColumn("n", F.max(F.when(F.col("at") == d, F.col("x"))).over(Window.partitionBy(F.lit(0))))
    return total.where(F.col("at") < d).select(F.col("at").alias("i"), (F.col("x") / F.col("n")).alias("mean"), F.col("n").cast("long").alias("n"))


def _centre(vectors: DataFrame, vector: str, d: int) -> tuple[np.ndarray, int]:
    found = sorted((r["i"], r["mean"], r["n"]) for r in mean(vectors, vector, d).collect())
    return np.array([m for _, m, _ in found]), found[0][2] if found else 0


def covariance(vectors: DataFrame, vector: str = "embedding", d: int | None = None) -> DataFrame:
    """Rows (i, j, covariance) for i <= j, over the number of vectors: sums of outer products of centred vectors by task, then by place.

    The mean is taken first, so no digits cancel. Tasks send half a matrix each, whatever their rows."""
    d = dimension(vectors, vector) if d is None else d
    centre, n = _centre(vectors, vector, d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((d, d))
        for batch in batches:
            rows, _ = matrix(batch.column(0), d)
            rows -= centre
            sums += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([sums[i, i:].tolist() for i in range(d)], pa.list_(pa.float64()))], ["i", "sums"])

    if not n:
        return vectors.sparkSession.createDataFrame([], "i int, j int, covariance double")
    return _summed(vectors.select(vector).mapInArrow(run, "i int, sums array<double>"), "i").select("i", (F.col("i") + F.col("at")).alias("j"), (F.col("x") / n).alias("covariance"))


def components(vectors: DataFrame, k: int, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first k principal components (columns) and their shares of all variance.

    A component's sign makes its largest entry positive. The square of the dimension comes to the driver, no vector does."""
    d = dimension(vectors, vector)
    if not 1 <= k <= max(d, 1):
        raise InputError(f"between 1 and {d} components can be taken, not {k}")
    centre, n = _centre(vectors, vector, d)
    whole = np.zeros((d, d))
    for r in covariance(vectors, vector, d).collect() if n else ():
        whole[r["i"], r["j"]] = whole[r["j"], r["i"]] = r["covariance"]
    values, found = np.linalg.eigh(whole)
    values, found = values[::-1][:k], found[:, ::-1][:, :k]
    largest = np.abs(found).argmax(0) if d else np.zeros(0, int)
    signs = np.where(found[largest, np.arange(found.shape[1])] < 0, -1.0, 1.0)
    return centre, found * signs, values / (np.trace(whole) or 1.0)


def project(vectors: DataFrame, k: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and coordinates of every vector along the first k principal components; null for one that takes no part."""
    centre, axes, _ = components(vectors, k, vector)
    d = len(centre)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column(1), d)
            found: list[list[float] | None] = [None] * len(batch)
            for i, x in zip(at.tolist(), ((rows - centre) @ axes).tolist() if d else [], strict=True):
                found[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], [key, "coordinates"])

    return vectors.select(key, vector).mapInArrow(run, f"{key} {vectors.schema[key].dataType.simpleString()}, coordinates array<double>")


def _packed(block: int | None, d: int):
    """Rows (block, ids, flat) of unit vectors: one for each task, or for each ``block`` vectors. Vectors without a length take no part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            ids, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ids]), pa.array([rows.ravel()])], ["block", "ids", "flat"])

        for batch in batches:
            rows, at = matrix(batch.column(1), d)
            length = np.sqrt((rows * rows).sum(1))
            far = (length > 0) & np.isfinite(length) & np.isfinite(1 / np.maximum(length, 1e-300))
            ids = batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, rows = ids[far], rows[far] / length[far][:, None]
            for i in range(0, len(ids), block or len(ids) or 1):
                held.append((ids[i : i + block] if block else ids, rows[i : i + block] if block else rows))
                if block:
                    yield row()
                    held.clear()
        if sum(len(x[0]) for x in held):
            yield row()

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row and their ids, equal scores by smaller id. ``ids`` belongs to all rows, or has a row for each."""
    n = scores.shape[1]
    if ids.ndim == 1:
        if n > 4 * k:
            cut = np.partition(scores, n - k, 1)[:, n - k]
            at = np.empty((len(scores), k), np.int64)
            several = np.flatnonzero((scores >= cut[:, None]).sum(1) > k)
            plain = np.setdiff1d(np.arange(len(scores)), several, assume_unique=True)
            at[plain] = np.argpartition(scores[plain], n - k, 1)[:, n - k :]
            for q in several:
                some = np.flatnonzero(scores[q] >= cut[q])
                at[q] = some[np.lexsort((ids[some], -scores[q, some]))[:k]]
            scores, ids = np.take_along_axis(scores, at, 1), ids[at]
        else:
            ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _searched(d: int, k: int, own: bool):
    """Products of blocks of queries and vectors; a task keeps the k best of each query it has met."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for asked, scores, ids in held.values():
                there = np.isfinite(scores)
                who = np.broadcast_to(asked[:, None], ids.shape)[there]
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[there]), pa.array(scores[there])], ["query_id", "id", "score"])
            held.clear()

        for batch in batches:
            for row in range(len(batch)):
                block = batch.column("block")[row].as_py()
                asked, queries, ids, flat = (batch.column(c)[row].values.to_numpy() for c in ("asked", "queries", "ids", "flat"))
                scores = np.round(queries.reshape(-1, d) @ flat.reshape(-1, d).T, DECIMALS) + 0.0
                if not own:
                    scores[asked[:, None] == ids[None, :]] = -np.inf
                found = best(scores, ids, k)
                if block in held:
                    found = best(np.concatenate([held[block][1], found[0]], 1), np.concatenate([held[block][2], found[1]], 1), k)
                held[block] = (asked, *found)
            if sum(x[2].size for x in held.values()) > HELD:
                yield from rows()
        yield from rows()

    return run


def nearest_of(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", own: bool = True) -> DataFrame:
    """query_id, rank, the key and score (cosine) of the k nearest vectors of each query; equal scores go by the key. Without ``own`` a query's own key is left out.

    Queries are a table like the vectors (query_key, vector). Blocks of them go to every task if they are small by their number; else blocks of both meet in a
    shuffle. Every task keeps k rows for each query, and only these are ranked.
    """
    d = dimension(vectors, vector)
    n = queries.count()
    packed = "block int, ids array<long>, flat array<double>"
    blocks = max(1, -(-n // QUERY_BLOCK))
    asked = queries.select(query_key, vector).repartition(blocks).mapInArrow(_packed(None, d), packed).select("block", F.col("ids").alias("asked"), F.col("flat").alias("queries"))
    parts = vectors.select(key, vector).mapInArrow(_packed(VECTOR_BLOCK, d), packed).select("ids", "flat", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    pairs = parts.join(F.broadcast(asked) if n * d * 8 <= BROADCAST_BYTES else asked, "block")
    found = pairs.mapInArrow(_searched(d, k, own), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").alias(query_key), "rank", F.col("id").alias(key), "score")
