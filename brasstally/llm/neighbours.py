"""Approximate nearest neighbours by stable projections and kd-trees (after Sun et al., 2014).

Unit vectors are projected on a few random Gaussian directions. The planes of a kd-tree over a bounded sample of projections cut the space into
cells; every distinct vector goes to its cell, where a kd-tree of all its projections is the index. A query walks a tree's leaves by their distance in
the projection and verifies exactly those of their vectors whose own projected distance passes the test. The squared ratio of projected to true distance is
chi-square distributed, so the walk ends once a vector nearer than the worst of the best so far would, with probability
``CONFIDENCE``, have had a smaller projected distance than the next leaf, and so vectors beyond that distance are left out. A query first searches its own cell; the same test then says which other
cells can hold a nearer vector, and only there it is sent. A task builds a cell's tree once and lets queries stream through it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasstally.llm.common import cut

#: Chosen by recall and work on the given tables, see the README: with fewer directions or more confidence the test stops later, with less it misses more.
DIRECTIONS = 16
CONFIDENCE = 0.96
LEAF = 512
#: Squared distances are known to so much, about: vectors of one direction aren't left out for rounding.
SLACK = 1e-9
#: Distinct vectors in a cell, about, and projections that the cells' planes are fitted on, about.
BLOCK_ROWS, SAMPLE = 16_384, 65_536
_FOUND = "key long, vec_id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square with m degrees of freedom <= x) = p, for even m."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        cdf = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if cdf < p else (low, x)
    return high


class Tree:
    """kd-tree over points, split at the median of the widest side; a leaf has at most LEAF points but for equal ones."""

    def __init__(self, points: np.ndarray):
        self.low, self.high, self.kids, self.rows = [], [], [], []
        self._build(points, np.arange(len(points)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, points: np.ndarray, rows: np.ndarray) -> int:
        own = points[rows]
        at = len(self.kids)
        self.low.append(own.min(axis=0)), self.high.append(own.max(axis=0))
        self.kids.append(None), self.rows.append(rows)
        side = int(np.argmax(self.high[at] - self.low[at]))
        if len(rows) > LEAF and self.high[at][side] > self.low[at][side]:
            half = len(rows) // 2
            order = np.argpartition(own[:, side], half)
            self.rows[at] = None
            self.kids[at] = (self._build(points, rows[order[:half]]), self._build(points, rows[order[half:]]))
        return at

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, object]]:
        """(squared distance to the leaf's box, its rows), nearest first."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        far = np.einsum("ij,ij->i", gap, gap).tolist()
        heap = [(far[0], 0)]
        while heap:
            d, at = heapq.heappop(heap)
            if self.kids[at] is None:
                yield d, self.rows[at]
            else:
                for kid in self.kids[at]:
                    heapq.heappush(heap, (far[kid], kid))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one, so that no product can over- or underflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def projected(v: np.ndarray) -> np.ndarray:
    """Projections of the unit vectors; all vectors of one length meet the same directions."""
    own = scaled(v)
    return own / np.linalg.norm(own, axis=1, keepdims=True) @ np.random.default_rng(7).standard_normal((v.shape[1], DIRECTIONS))


@dataclass(frozen=True)
class Cells:
    """A space cut by planes: nodes (side, bound, left, right) of which negative kids are cells, and the cells' regions."""

    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def fitted(sample: np.ndarray, cells: int) -> Cells:
        """About so many cells, cut at medians of the widest sides of the sample; equal points can't be cut."""
        nodes: list[tuple[float, ...]] = []
        low, high = [], []

        def build(points: np.ndarray, want: int, lo: np.ndarray, hi: np.ndarray) -> int:
            if want > 1 and len(points) > 1:
                side = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
                bound = float(np.median(points[:, side]))
                left = points[:, side] <= bound
                if left.any() and not left.all():
                    at = len(nodes)
                    nodes.append((side, bound, 0, 0))
                    mid_hi, mid_lo = hi.copy(), lo.copy()
                    mid_hi[side], mid_lo[side] = bound, bound
                    nodes[at] = (side, bound, build(points[left], want // 2, lo, mid_hi), build(points[~left], want - want // 2, mid_lo, hi))
                    return at
            low.append(lo), high.append(hi)
            return -len(low)

        m = sample.shape[1]
        build(sample, cells, np.full(m, -np.inf), np.full(m, np.inf))
        return Cells(np.array(nodes).reshape(-1, 4), np.array(low), np.array(high))

    def of(self, points: np.ndarray) -> np.ndarray:
        """Each point's cell."""
        at = np.full(len(points), 0 if len(self.nodes) else -1)
        while (at >= 0).any():
            inner = np.nonzero(at >= 0)[0]
            node = self.nodes[at[inner]]
            left = points[inner, node[:, 0].astype(int)] <= node[:, 1]
            at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)
        return -at - 1

    def near(self, point: np.ndarray, reach: float) -> np.ndarray:
        """Cells whose regions are within the squared distance ``reach``."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.nonzero(np.einsum("ij,ij->i", gap, gap) <= reach)[0]


def _limit() -> float:
    return chi_square_quantile(CONFIDENCE, DIRECTIONS)


class Index:
    """The vectors of one cell with their ids, and a kd-tree of their projections."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]]):
        points = projected(vectors)
        self.tree, self.limit, self.verified = Tree(points), _limit(), 0
        # leaf by leaf, so that each one's rows are a slice
        order = np.concatenate([r for r in self.tree.rows if r is not None])
        at = 0
        for i, r in enumerate(self.tree.rows):
            if r is not None:
                self.tree.rows[i] = (at, at := at + len(r))
        self.own, self.ids, self.points = scaled(vectors)[order], [ids[i] for i in order], points[order]
        self.norm, self.square = np.sqrt(np.einsum("ij,ij->i", self.own, self.own)), np.einsum("ij,ij->i", self.points, self.points)

    def search(self, q: np.ndarray, p: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[float, int]]:
        """(cosine, id) of the k nearest of those that reach ``least``, ties to smaller ids."""
        norm = math.sqrt(np.einsum("i,i->", q, q))
        best: list[tuple[float, int]] = []  # (cosine, -id), worst first
        own_square = float(p @ p)
        for near, (a, b) in self.tree.leaves(p):
            worst = max(least, best[0][0]) if len(best) == k else least
            reach = self.limit * (2 - 2 * worst) + SLACK
            if near > reach:
                break
            # the leaf's vectors are put to the same test, each by itself
            rows = a + np.flatnonzero(self.square[a:b] - 2 * (self.points[a:b] @ p) + own_square <= reach)
            self.verified += len(rows)
            cos = np.einsum("ij,j->i", self.own[rows], q) / (self.norm[rows] * norm)
            for r in np.nonzero(cos >= worst)[0]:
                for i in self.ids[rows[r]]:
                    item = (float(cos[r]), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        return [(c, -i) for c, i in best]


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch[name]
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that is sorted by size and cell: rows of one size, cell and kind."""
    if not batch.num_rows:
        return
    key = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("size", "cell", "asked") if c in batch.schema.names])
    edges = [0, *(np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _usable(v: Column) -> Column:
    """Vectors that aren't null or zero and whose components are all finite."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _placed(df: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """``df`` (v, size and others) with cell."""
    shared = df.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = [int(shared.value[len(v)].of(projected(np.array([v])))[0]) for v in batch["v"].to_pylist()] if len(set(batch["size"].to_pylist())) > 1 else shared.value[batch["size"][0].as_py()].of(projected(_matrix(batch))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", cell int")


def _searched(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """key, vec_id and score of the k best of each query's cell; rows: v, ids, size, cell; asked: v, key, least, size, cell."""
    none = F.lit(None)
    both = rows.select("size", "cell", F.lit(False).alias("asked"), "v", "ids", none.cast("long").alias("key"), none.cast("double").alias("least")).unionByName(
        asked.select("size", "cell", F.lit(True).alias("asked"), "v", none.cast("array<long>").alias("ids"), "key", "least")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vectors, ids, index = None, [], [], None
        for batch in batches:
            for part in _by_size(batch):
                cell = (part["size"][0].as_py(), part["cell"][0].as_py())
                if cell != at:
                    at, vectors, ids, index = cell, [], [], None
                if not part["asked"][0].as_py():
                    vectors.append(_matrix(part))
                    ids += part["ids"].to_pylist()
                    continue
                if not ids:
                    continue
                index = index or Index(np.concatenate(vectors), ids)
                own = _matrix(part)
                found = [(key, *x) for key, q, p, least in zip(part["key"].to_pylist(), scaled(own), projected(own), part["least"].to_pylist(), strict=True) for x in index.search(q, p, k, least)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["key", "vec_id", "score"])

    return both.repartition("size", "cell").sortWithinPartitions("size", "cell", "asked").mapInArrow(run, _FOUND)


def _routed(asked: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """Queries (v, key, size, cell and least, the worst of their best so far) for every other cell that may hold a nearer vector."""
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = _limit()
        for batch in batches:
            row, to = [], []
            for i, (v, own, least) in enumerate(zip(batch["v"].to_pylist(), batch["cell"].to_pylist(), batch["least"].to_pylist(), strict=True)):
                near = shared.value[len(v)].near(projected(np.array([v]))[0], limit * (2 - 2 * least))
                near = near[near != own].tolist()
                row += [i] * len(near)
                to += near
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken[c] for c in ("v", "key", "least", "size")), pa.array(to, pa.int32())], names=["v", "key", "least", "size", "cell"])

    return asked.select("v", "key", "least", "size", "cell").mapInArrow(run, "v array<double>, key long, least double, size int, cell int")


def _cells(distinct: DataFrame, block_rows: int) -> dict[int, Cells]:
    """The cells of each length of vectors, fitted on about SAMPLE of its distinct vectors (by hash)."""
    sizes = {r["size"]: r["n"] for r in distinct.groupBy("size").agg(F.count("*").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [projected(np.array([v]))[0] for v in batch["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["size"], pa.array([p.tolist() for p in points], pa.list_(pa.float64()))], names=["size", "p"])

    large = {size: n for size, n in sizes.items() if n > block_rows}
    points: dict[int, list] = {}
    if large:
        share = F.create_map(*(F.lit(x) for kv in large.items() for x in kv))[F.col("size")]
        few = distinct.where(F.pmod(F.xxhash64("v"), share.cast("long")) < SAMPLE).select("v", "size")
        for r in few.mapInArrow(run, "size int, p array<double>").toLocalIterator():
            points.setdefault(r["size"], []).append(r["p"])
    return {size: Cells.fitted(np.array(sorted(points.get(size, []))).reshape(-1, DIRECTIONS), -(-n // block_rows)) for size, n in sizes.items()}


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest of the rows whose vec_id is divisible by ``every``.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; vectors of
    different lengths aren't compared. Very large and very small components are scaled by powers of two. Rows of one vec_id count once, with the vector
    that sorts first. Equal scores rank by vec_id. Equal vectors are one row of the index with their k + 1 smallest ids, and equal queries are searched
    once. Other columns are ignored; an empty table gives an empty result. What is broadcast are the cells' bounds, 300 bytes for ``block_rows`` vectors.
    """
    clean = cut(
        vectors.where(F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
        .where(_usable(F.col("v")))
        .groupBy("vec_id").agg(F.min("v").alias("v"))
    )
    few = clean.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    distinct = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("size", F.size("v")))
    cells = _cells(distinct, block_rows)
    rows = _placed(distinct, cells)
    queries = clean.where(F.pmod("vec_id", F.lit(every)) == 0)
    keys = queries.groupBy("v").agg(F.min("vec_id").alias("key"))
    asked = cut(_placed(keys.select("v", "key", F.size("v").alias("size")), cells))
    # a query's own row is among its nearest, so one more is looked for
    found = _searched(rows, asked.withColumn("least", F.lit(-1.0)), k + 1)
    if any(len(c.low) > 1 for c in cells.values()):
        rows, found = cut(rows), cut(found)
        bound = found.groupBy("key").agg(F.when(F.count("*") > k, F.min("score")).otherwise(-1.0).alias("least"))
        known = asked.join(bound, "key", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
        found = found.unionByName(_searched(rows, _routed(known, cells), k + 1))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    named = queries.join(keys, "v").select(F.col("vec_id").alias("query_id"), "key")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    others = named.join(found, "key").where("vec_id <> query_id")
    return others.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
