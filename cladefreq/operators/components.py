"""Covariance and principal components of a 0/1 matrix in its sparse form.

The covariance needs how often each pair of features occurs together: pairs are
counted where the entities lie, so what is shuffled are counts. Everything here
is lazy. The components are found from the covariance, whose size depends on the
number of features and not on the data: one task holds features x features
numbers, 8 MB for a thousand features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.operators.grid import dense_grid


def pair_counts(sets: DataFrame) -> DataFrame:
    """``feature_a, feature_b, n``: entities that have both, for a <= b in name order.

    ``sets`` has one sorted array ``features`` per entity. Pairs of an entity come
    out one after the other, and are counted before anything is shuffled.
    """
    first = sets.select("features", F.posexplode("features").alias("_i", "feature_a"))
    rest = F.slice("features", F.col("_i") + 1, F.size("features"))
    return (
        first.select("feature_a", F.explode(rest).alias("feature_b"))
        .groupBy("feature_a", "feature_b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def feature_covariance(sets: DataFrame) -> DataFrame:
    """Sample covariance of every pair of features, in long form, from whole-number counts.

    An entity is one row of ``sets``; one with an empty array counts as a row of
    zeros. The numerator n * n_ab - n_a * n_b is exact.
    """
    n = sets.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    upper = pair_counts(sets)
    both = upper.select(
        F.inline(
            F.when(
                F.col("feature_a") == F.col("feature_b"),
                F.array(F.struct("feature_a", "feature_b", "n")),
            ).otherwise(
                F.array(
                    F.struct("feature_a", "feature_b", "n"),
                    F.struct(
                        F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "n"
                    ),
                )
            )
        )
    )
    dense = dense_grid(both, "feature_a", "feature_b", ["n"])
    # A feature's own count stands on the diagonal; every partition here has one row per feature.
    own = F.when(F.col("feature_a") == F.col("feature_b"), F.col("n"))
    known = dense.withColumn("n_a", F.max(own).over(W.partitionBy("feature_a"))).withColumn(
        "n_b", F.max(own).over(W.partitionBy("feature_b"))
    )

    def whole(value):
        return value.cast("decimal(19,0)")

    top = whole(n) * whole(F.col("n")) - whole(F.col("n_a")) * whole(F.col("n_b"))
    below = n.cast("double") * (n - 1)
    return known.select(
        "feature_a",
        "feature_b",
        F.when(below > 0, top.cast("double") / below).alias("covariance"),
        n.alias("n_rows"),
    )


#: Loadings this close to the largest one count as large; the first by name is then made positive.
SIGN_TOLERANCE = 1e-9


def decompose(names: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending and not below zero, and loadings by column; the largest of each is positive."""
    eigenvalues, loadings = np.linalg.eigh((values + values.T) / 2)
    eigenvalues, loadings = np.clip(eigenvalues[::-1], 0, None), loadings[:, ::-1]
    size = np.abs(loadings)
    first = (size >= size.max(axis=0) - SIGN_TOLERANCE).argmax(axis=0)
    return eigenvalues, loadings * np.sign(loadings[first, np.arange(len(names))])


def _in_one_task(covariance: DataFrame, schema: str, table) -> DataFrame:
    """Rows that ``table`` (names, matrix, rows) makes of the whole covariance."""
    columns = [field.split()[0] for field in schema.split(", ")]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        own = pa.Table.from_batches(parts)
        names = sorted(set(own["feature_a"].to_pylist()))
        at = {name: i for i, name in enumerate(names)}
        values = np.zeros((len(names), len(names)))
        rows = [at[a] for a in own["feature_a"].to_pylist()]
        values[rows, [at[b] for b in own["feature_b"].to_pylist()]] = np.nan_to_num(own["covariance"].to_numpy())
        arrays = table(names, values, own["n_rows"][0].as_py())
        yield pa.RecordBatch.from_arrays(arrays, columns)

    wanted = covariance.select("feature_a", "feature_b", "covariance", "n_rows")
    return wanted.repartition(1).mapInArrow(found, schema)


def variance_table(covariance: DataFrame) -> DataFrame:
    """Scree table: deviation (n - 1), eigenvalue (n), share and cumulative share of each component."""

    def table(names, values, n_rows):
        eigenvalues, _ = decompose(names, values)
        total = eigenvalues.sum()
        shares = eigenvalues / total if total > 0 else np.zeros_like(eigenvalues)
        last = min(n_rows, len(names))
        eigenvalues, shares = eigenvalues[:last], shares[:last]
        return [
            pa.array(range(1, last + 1), pa.int32()),
            pa.array(np.sqrt(eigenvalues)),
            pa.array(eigenvalues * (n_rows - 1) / n_rows),
            pa.array(shares),
            pa.array(np.cumsum(shares)),
        ]

    schema = "component int, std_dev double, eigenvalue double, share double, cumulative_share double"
    return _in_one_task(covariance, schema, table)


def variable_map(covariance: DataFrame, min_cos2: float = presets.MIN_COS2) -> DataFrame:
    """Coordinates of the features on the first two components and how well these
    represent them; ``kept`` marks a cos2 of at least ``min_cos2``.

    Coordinates use divisor n; cos2 does not depend on the divisor. A feature
    that does not vary has no cos2.
    """

    def table(names, values, n_rows):
        eigenvalues, loadings = decompose(names, values)
        axes = min(2, len(names))
        coords = np.zeros((len(names), 2))
        coords[:, :axes] = loadings[:, :axes] * np.sqrt(eigenvalues[:axes])
        variances = np.diag(values)
        varies = variances > 0
        cos2 = (coords**2).sum(axis=1) / np.where(varies, variances, 1.0)
        scale = np.sqrt((n_rows - 1) / n_rows)
        return [
            pa.array(names),
            pa.array(coords[:, 0] * scale),
            pa.array(coords[:, 1] * scale),
            pa.array(cos2, mask=~varies),
            pa.array(varies & (cos2 >= min_cos2)),
        ]

    schema = "feature string, coord1 double, coord2 double, cos2 double, kept boolean"
    return _in_one_task(covariance, schema, table)
