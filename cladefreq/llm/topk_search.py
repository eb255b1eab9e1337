"""Exact top-k search by integer inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are sorted by descending length and cut into tiles; queries are cut into blocks. Every block first meets the tile
of the longest vectors, which gives each query a score to beat. Then it meets every other tile: rows are taken by
descending length and stop once no product of lengths reaches the score to beat; for the rest the leading rotated
components are summed, the products of what is left of both lengths bound the remainder, and only pairs that could still
reach the score are multiplied exactly, in integers. Scores to beat rise as a tile is read; ties stay in.

Components become floor(scale * x). Null ids, null vectors and those with null or non-finite components take no part;
vectors of different length never meet. Rows that share an id are rows of their own: each is a query where its id is one,
and only itself is no candidate. An empty table, or one without queries, gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladefreq.llm.common import stored
from cladefreq.llm.vectors import directions, takes_part, tiles

TILE = 16_384
BLOCK = 2_048
#: Rotated components summed before each test.
STEPS = (16, 32)
ROWS_AT_ONCE = 1_024
FOUND = "block int, query long, query_id long, vec_id long, score long"


class Best:
    """The k best of each query so far, and the score that a further one must reach."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.query = k, np.zeros(0, np.int64)
        self.key, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, -np.inf)

    def add(self, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        query, key, score = np.r_[self.query, query], np.r_[self.key, key], np.r_[self.score, score]
        order = np.lexsort((key, -score, query))
        query, key, score = query[order], key[order], score[order]
        first = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        keep = rank < self.k
        self.query, self.key, self.score = query[keep], key[keep], score[keep]
        full = rank == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])


def search(
    q_rows: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, best: Best
) -> None:
    """Add to `best` what the rows `x` (descending length, integers as doubles) hold for the queries `q`."""
    q_turned, x_turned = q @ rotation, x @ rotation
    q_length, x_length = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    steps = [s for s in STEPS if s < x.shape[1]]
    q_rest = [np.linalg.norm(q_turned[:, s:], axis=1) for s in steps]
    x_rest = [np.linalg.norm(x_turned[:, s:], axis=1) for s in steps]
    slack = 1e-6 * (1 + q_length.max(initial=0) * x_length.max(initial=0))
    for a in range(0, len(x), ROWS_AT_ONCE):
        own = slice(a, a + ROWS_AT_ONCE)
        live = np.flatnonzero(q_length * x_length[a] >= best.floor - slack)
        if not len(live):
            return
        if steps:
            s = steps[0]
            bound = q_turned[live, :s] @ x_turned[own, :s].T + np.outer(q_rest[0][live], x_rest[0][own])
            i, j = np.nonzero(bound >= (best.floor[live] - slack)[:, None])
        else:
            i, j = (m.ravel() for m in np.indices((len(live), len(x_length[own]))))
        i, j = live[i], j + a
        for k in range(1, len(steps)):
            s = steps[k]
            partial = np.einsum("nd,nd->n", q_turned[i, :s], x_turned[j, :s])
            keep = partial + q_rest[k][i] * x_rest[k][j] >= best.floor[i] - slack
            i, j = i[keep], j[keep]
        for b in range(0, len(i), 1 << 18):
            i_own, j_own = i[b : b + (1 << 18)], j[b : b + (1 << 18)]
            score = np.einsum("nd,nd->n", q[i_own].astype(np.int64), x[j_own].astype(np.int64))
            keep = (rows[j_own] != q_rows[i_own]) & (score >= best.floor[i_own])
            best.add(i_own[keep], ids[j_own[keep]], score[keep])


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and vectors of a tile."""
    ids = np.frombuffer(row["ids"], "<i8")
    return np.frombuffer(row["weights"], "<i8"), ids, np.frombuffer(row["matrix"], "<f8").reshape(len(ids), -1)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` best other rows of every row where `is_query` holds (a condition on
    the id column), ties to the smaller id."""
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    own = F.coalesce(is_query, F.lit(False)).alias("asks")
    rows = vectors.where(takes_part(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), own, whole.alias("v")
    )
    # `weight` carries the number of the row.
    rows = stored(rows.withColumn("weight", F.monotonically_increasing_id()), "topk-vectors").withColumns(
        {"dim": F.size("v"), "label": F.lit(""), "length": F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)}
    )
    turns = rows.sparkSession.sparkContext.broadcast(directions(rows, centred=False))
    order = ["dim", F.desc("length"), "id", "weight"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = stored(tiles(ordered, TILE), "topk-tiles")
    # Number the tiles of each dim from the longest vectors on; a row per tile, without its vectors.
    order = Window.partitionBy("dim").orderBy("part", "place")
    numbers = made.select("part", "place", "dim", (F.row_number().over(order) - 1).alias("tile"))
    made = made.join(numbers, ["part", "place", "dim"]).select("dim", "tile", "ids", "weights", "matrix")
    queries = rows.where("asks")
    sizes = {r["dim"]: r["count"] for r in queries.groupBy("dim").count().collect()}
    counts = {r["dim"]: r["count"] for r in numbers.groupBy("dim").count().collect()}
    one_of = lambda table: F.coalesce(*[F.when(F.col("dim") == d, F.lit(n)) for d, n in table.items()], F.lit(1))
    blocks_of = {d: -(-n // BLOCK) for d, n in sizes.items()}
    block = F.pmod(F.xxhash64("id", "weight"), one_of(blocks_of)).cast("int")
    blocks = queries.withColumn("block", block).groupBy("dim", "block").agg(
        F.sort_array(F.collect_list(F.struct("id", F.col("weight").alias("row"), "v"))).alias("rows")
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def packed(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = row["rows"]
        return *(np.array([r[k] for r in own], np.int64) for k in ("row", "id")), np.array([r["v"] for r in own], np.float64)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({x.split()[0]: pa.array([], t) for x, t in zip(FOUND.split(", "), types, strict=True)})
        row = right.to_pylist()[0]
        q_rows, q_ids, q = packed(row)
        best = Best(len(q_ids), k)
        if row.get("floors") is not None:
            floors = dict(zip(row["floor_ids"], row["floors"], strict=True))
            best.floor = np.array([floors.get(x, -np.inf) for x in q_rows.tolist()])
        for tile in left.to_pylist():
            row_ids, ids, x = _matrix(tile)
            search(q_rows, q, row_ids, ids, x, turns.value[x.shape[1]], best)
        n = len(best.query)
        columns = (np.full(n, row["block"], np.int32), q_rows[best.query], q_ids[best.query], best.key, best.score)
        return pa.table({x.split()[0]: pa.array(c, t) for x, c, t in zip(FOUND.split(", "), columns, types, strict=True)})

    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    first = made.where("tile = 0").withColumn("block", every(one_of(blocks_of)))
    seed = stored(
        first.groupBy("dim", "block").cogroup(blocks.groupBy("dim", "block")).applyInArrow(meet, FOUND), "topk-seed"
    )
    # The k-th best of each query so far; those with fewer have no score to beat.
    floors = seed.groupBy("block", "query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    ids_of = rows.select(F.col("weight").alias("query"), "dim")
    by_block = floors.join(ids_of, "query").groupBy("dim", "block").agg(
        F.collect_list("query").alias("floor_ids"), F.collect_list(F.col("floor").cast("double")).alias("floors")
    )
    rest = made.where("tile > 0").withColumn("block", every(one_of(blocks_of)))
    armed = blocks.join(by_block, ["dim", "block"], "left").withColumn("tile", every(one_of(counts))).where("tile > 0")
    keys = ("dim", "block", "tile")
    later = rest.groupBy(*keys).cogroup(armed.groupBy(*keys)).applyInArrow(meet, FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = seed.union(later).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
