"""Vectors for the searches: which take part, tiles of them, and the directions in which they vary most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: str) -> Column:
    """Not null or empty, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite


def tiles(rows: DataFrame, size: int, bounds: int = 0) -> DataFrame:
    """Consecutive rows (label, dim, id, weight, v array<double>) of each partition in tiles of one label and dim.

    A tile: part, place (its number there), label, dim, ids and weights (longs), matrix (doubles, row by row), and the
    least and greatest value of each of the first `bounds` components of `key` (array<double>).
    """

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, last = TaskContext.get().partitionId(), 0, [], None

        def close() -> pa.RecordBatch:
            nonlocal place
            ids = np.array([r[0] for r in held], "<i8")
            weights = np.array([r[1] for r in held], "<i8")
            matrix = np.array([r[2] for r in held], "<f8")
            keys = np.array([r[3] for r in held], "<f8").reshape(len(held), -1)
            row = (part, place, *last, ids.tobytes(), weights.tobytes(), matrix.tobytes(), keys.min(0).tolist() if bounds else [], keys.max(0).tolist() if bounds else [])
            place += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for label, dim, key, weight, v, bound in zip(*columns, strict=True):
                if held and ((label, dim) != last or len(held) >= size):
                    yield close()
                last = (label, dim)
                held.append((key, weight, v, bound[:bounds]))
        if held:
            yield close()

    numbers = pa.list_(pa.float64())
    types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), numbers, numbers)
    schema = "part int, place int, label string, dim int, ids binary, weights binary, matrix binary, low array<double>, high array<double>"
    names = [x.split()[0] for x in schema.split(", ")]
    key = F.col("key") if bounds else F.array().cast("array<double>")
    chosen = rows.select(F.col("label").cast("string"), F.col("dim").cast("int"), "id", "weight", "v", key.alias("key"))
    return chosen.mapInArrow(tiled, schema)


def directions(rows: DataFrame, centred: bool) -> dict[int, np.ndarray]:
    """Per dim, orthonormal columns by descending second moment (about the mean if `centred`) of all vectors `v`.

    Each task sums its own moments; what reaches the driver is dim x dim numbers per distinct dim.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.asarray(batch.column(0))
            values = batch.column(1)
            for dim in np.unique(dims).tolist():
                own = values.filter(pa.array(dims == dim))
                x = np.asarray(own.flatten(), np.float64).reshape(-1, dim)
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, m in sums.items():
            at = np.indices(m.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, dim, np.int32)), *(pa.array(a.astype(np.int32)) for a in at), pa.array(m.ravel())],
                ["dim", "i", "j", "x"],
            )

    found: dict[int, np.ndarray] = {}
    sums = rows.select(F.col("dim").cast("int"), "v").mapInArrow(moments, "dim int, i int, j int, x double")
    for r in sums.groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).collect():
        found.setdefault(r["dim"], np.zeros((r["dim"] + 1, r["dim"] + 1)))[r["i"], r["j"]] = r["x"]
    out = {}
    for dim, m in found.items():
        second, first, n = m[:dim, :dim], m[dim, :dim], m[dim, dim]
        if centred:
            second = second - np.outer(first, first) / n
        out[dim] = np.linalg.eigh((second + second.T) / 2)[1][:, ::-1].copy()
    return out
