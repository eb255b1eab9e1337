"""Positions of rows in a total order, without one task for all rows or for all equal ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladefreq.sources.writers import written


def numbered(rows: DataFrame, order: Sequence[Column], within: str | None = None) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in the given order) and ``n`` (rows), within each value of ``within``.

    Rows are dealt by ranges of (within, order) and stored, each range counts its
    own, and a prefix sum over the ranges does the rest: it has a row per range
    and value in it. Rows equal in all of ``order`` are told apart by their place
    in the input, so a long tie is spread like anything else. ``within`` may be
    null.
    """
    group = F.lit(0) if within is None else F.col(within)
    tied = rows.withColumns({"_within": group, "_tie": F.monotonically_increasing_id()})
    keys = [F.col("_within").asc_nulls_first(), *order, F.col("_tie")]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = written(
        dealt.withColumns({"_part": F.spark_partition_id(), "_line": F.monotonically_increasing_id()})
    )
    runs = placed.groupBy(F.col("_within").alias("_of"), F.col("_part").alias("_run")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first")
    )
    whole = W.partitionBy("_of")
    earlier = whole.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    shifts = runs.select(
        "_of",
        "_run",
        F.sum("_n").over(whole).alias("n"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    on = F.col("_within").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_run"))
    return (
        placed.join(shifts, on)
        .withColumn("pos", F.col("_line") + F.col("_shift"))
        .drop("_within", "_part", "_line", "_of", "_run", "_shift")
    )
