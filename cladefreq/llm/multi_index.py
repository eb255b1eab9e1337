"""Approximate nearest neighbours: an inverted multi-index over two halves of the vectors, for the largest inner products.

Each half has its own codebook, fitted by k-means on a sample of at most SAMPLE vectors (those of the least hash, so the
same ones at every run). A vector's cell is the pair of its halves' centroids. For a query the distance of a cell is the
sum of two distances, one from each half; a heap yields the pairs in ascending order of that sum, and cells are visited until
they hold `share` of all rows. The share is measured on the sample: the least at which `target` of the true neighbours lie in
visited cells. Every vector is indexed, every row of a visited cell is met, and the rows met are ranked by the inner
product in double precision.

Queries travel in blocks of BLOCK that lie near each other; a block meets the cells that one of its queries visits, CHUNK
rows of the index at a time, so neither a cell with any share of the rows nor a query that visits many is one task's work.

Null, empty and zero vectors, those with null or non-finite components and rows with a null id take no part; vectors of
different length never meet. Lengths that the sample lacks have one cell, visited whole. Rows that share an id are rows of
their own: each is a query where its id is one, and only itself is no candidate. Equal products are taken by the smaller
id. An empty table, or one without queries, gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladefreq.llm.common import numbered, stored
from cladefreq.llm.vectors import takes_part

#: Vectors that the codebooks and the share are fitted on.
SAMPLE = 16_384
#: Numbers in the sample: fewer vectors are taken where they are long, so that the driver holds 32 MB at most.
SAMPLE_NUMBERS = 1 << 22
#: Centroids per half, at most; fewer if the sample has less than PER_CENTROID vectors for each.
CENTROIDS, PER_CENTROID = 64, 8
ROUNDS = 8
#: Sampled queries that the share is measured with.
PROBES = 256
BLOCK = 512
CHUNK = 1 << 15


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves, and the share of all rows that a query visits."""

    left: np.ndarray
    right: np.ndarray
    share: float

    @property
    def dim(self) -> int:
        return self.left.shape[1] + self.right.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Number of the cell of each vector."""
        half = self.left.shape[1]
        return nearest(x[:, :half], self.left) * len(self.right) + nearest(x[:, half:], self.right)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query, its distance from the centroids of either half."""
        half = self.left.shape[1]
        return -q[:, :half] @ self.left.T, -q[:, half:] @ self.right.T


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros(len(x), np.int64)
    out = np.empty(len(x), np.int64)
    squares = (centroids**2).sum(1) / 2
    for k in range(0, len(x), 8_192):
        out[k : k + 8_192] = (squares - x[k : k + 8_192] @ centroids.T).argmin(1)
    return out


def codebook(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of Lloyd's k-means from evenly spaced rows; empty ones stay where they were."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        of = nearest(x, centroids)
        counts = np.bincount(of, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


def in_order(left: np.ndarray, right: np.ndarray) -> Iterator[int]:
    """Numbers of all pairs by ascending sum: a pair is pushed once both pairs before it in its row and column were popped."""
    i_of, j_of = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    a, b = left[i_of].tolist(), right[j_of].tolist()
    rows, columns, width = i_of.tolist(), j_of.tolist(), len(b)
    heap = [(a[0] + b[0], 0, 0)]
    reached = [0] * len(a)
    while heap:
        _, i, j = heapq.heappop(heap)
        yield rows[i] * width + columns[j]
        reached[i] = j + 1
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


def visited(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells with rows, in order, until they hold `wanted` rows."""
    out, held = [], 0
    for cell in in_order(left, right):
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
            if held >= wanted:
                break
    return out


def fit(x: np.ndarray, k: int, target: float) -> Index:
    """Index of a sample `x`, with the share at which `target` of its own `k` nearest are found."""
    size = max(1, min(CENTROIDS, len(x) // PER_CENTROID, int(len(x) ** 0.5)))
    half = x.shape[1] // 2
    index = Index(codebook(x[:, :half], size), codebook(x[:, half:], size), 1.0)
    cells = index.cells(x)
    counts = np.bincount(cells, minlength=len(index.left) * len(index.right))
    probes = np.unique(np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int))
    k = min(k, len(x) - 1)
    if k < 1:
        return index
    products = x[probes] @ x.T
    products[np.arange(len(probes)), probes] = -np.inf
    neighbours = np.argpartition(-products, k - 1, axis=1)[:, :k]
    depths = []
    for own, left, right in zip(neighbours, *index.distances(x[probes]), strict=True):
        order = np.fromiter(in_order(left, right), np.int64, len(counts))
        before = np.empty(len(counts))
        before[order] = np.cumsum(counts[order])
        depths.extend(before[cells[own]])
    return Index(index.left, index.right, float(np.quantile(depths, target, method="higher")) / len(x))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed in order, so that equal pairs have equal products wherever they meet."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    target: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` rows found nearest to every row where `is_query` holds (a condition on
    the id column)."""
    asks = F.coalesce(is_query, F.lit(False)).alias("asks")
    numbers = F.col(vector_col).cast("array<double>").alias("v")
    rows = vectors.where(takes_part(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), asks, numbers)
    some = F.exists("v", lambda x: x != 0)
    rows = stored(rows.where(some).withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v")}), "index-rows")
    longest = rows.agg(F.max("dim")).first()[0] or 1
    size = max(1, min(SAMPLE, SAMPLE_NUMBERS // longest))
    sample = rows.orderBy(F.xxhash64("v", "id"), "row").limit(size).select("dim", "v").toPandas()
    indexes = {int(d): fit(np.stack(own["v"].to_numpy()), k, target) for d, own in sample.groupby("dim")}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            cell = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in indexes:
                    own = dims == dim
                    cell[own] = indexes[dim].cells(_matrix(batch.column(3).filter(pa.array(own)), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["row", "id", "dim", "v", "asks", "cell"])

    schema = "row long, id long, dim int, v array<double>, asks boolean, cell long"
    celled = rows.select("row", "id", "dim", "v", "asks").mapInArrow(placed, schema)
    index = stored(numbered(celled, "dim", [F.col("cell"), F.col("row")]), "index-cells")
    # A count for each of a bounded number of cells: those of the sampled lengths.
    known = F.col("dim").isin(list(indexes)) if indexes else F.lit(False)
    counts = {d: np.zeros(len(own.left) * len(own.right), np.int64) for d, own in indexes.items()}
    for r in index.where(known).groupBy("dim", "cell").count().collect():
        counts[r["dim"]][r["cell"]] = r["count"]

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = np.asarray(batch.column(2)), [[0]] * batch.num_rows
            for dim in np.unique(dims).tolist():
                if dim in indexes:
                    at = np.flatnonzero(dims == dim)
                    own, n = indexes[dim], counts[dim]
                    q = _matrix(batch.column(3).take(pa.array(at)), dim)
                    for i, left, right in zip(at.tolist(), *own.distances(q), strict=True):
                        cells[i] = visited(left, right, n, own.share * n.sum())
            columns = [*batch.columns, pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "dim", "v", "block", "cells"])

    asked = index.where("asks").select("row", "id", "dim", "v", "cell")
    asked = numbered(asked, "dim", [F.col("cell"), F.col("row")])
    block = F.call_function("div", F.col("pos"), F.lit(BLOCK)).alias("block")
    plan = stored(
        asked.select("row", "id", "dim", "v", block).mapInArrow(planned, "row long, id long, dim int, v array<double>, block long, cells array<long>"),
        "index-plan",
    )
    chunk = F.call_function("div", F.col("pos"), F.lit(CHUNK)).alias("chunk")
    wanted = plan.select("dim", "block", F.explode("cells").alias("cell")).distinct()
    # A block asks for a cell once per chunk of the index that holds rows of it.
    parts = index.select("dim", "cell", chunk).distinct()
    visits = stored(wanted.join(parts, ["dim", "cell"]), "index-visits")
    met = index.select("dim", "cell", chunk, "row", "id", "v").join(visits, ["dim", "cell", "chunk"])
    blocks = plan.join(visits.select("dim", "block", "chunk").distinct(), ["dim", "block"])

    found_schema = "query long, query_id long, vec_id long, score double"
    names = [c.split()[0] for c in found_schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], t) for t in types], names)
        if not left.num_rows or not right.num_rows:
            return none
        left, right = left.combine_chunks(), right.combine_chunks()
        dim = right["dim"][0].as_py()
        one = lambda table, name: np.asarray(table[name].combine_chunks())
        q, x = _matrix(left["v"].combine_chunks(), dim), _matrix(right["v"].combine_chunks(), dim)
        q_rows, q_ids, rows_, ids, cells = one(left, "row"), one(left, "id"), one(right, "row"), one(right, "id"), one(right, "cell")
        # Rows by id, so that the first of equal products is that of the smaller id.
        order = np.lexsort((rows_, ids))
        x, rows_, ids, cells = x[order], rows_[order], ids[order], cells[order]
        out = []
        slack = 1e-12 * np.linalg.norm(x, axis=1).max()
        for i, own in enumerate(left["cells"].to_pylist()):
            score = x @ q[i]
            score[~np.isin(cells, own) | (rows_ == q_rows[i])] = -np.inf
            if len(score) > k:
                floor = np.partition(score, len(score) - k)[len(score) - k]
                keep = np.flatnonzero((score >= floor - slack * np.linalg.norm(q[i])) & (score > -np.inf))
            else:
                keep = np.flatnonzero(score > -np.inf)
            exact = products(np.broadcast_to(q[i], (len(keep), dim)), x[keep])
            best = np.lexsort((ids[keep], -exact))[:k]
            out.append((np.full(len(best), q_rows[i]), np.full(len(best), q_ids[i]), ids[keep][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    keys = ("dim", "block", "chunk")
    found = blocks.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(ranked, found_schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
