"""Checks on key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys on more than one row, with their counts; empty for a proper lookup."""
    return (
        df.groupBy(F.col(key).cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where("n_rows > 1")
    )


def key_report(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row: rows, distinct keys and keys that repeat."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
    ).select(F.lit(name).alias("table_name"), "n_rows", "n_keys", "n_repeated")


def require_unique(df: DataFrame, key: str, name: str = "lookup") -> DataFrame:
    """Return the table, or fail naming some keys that repeat."""
    bad = [r["key"] for r in duplicate_keys(df, key).limit(5).collect()]
    if bad:
        raise ValueError(f"{name}: keys repeat in column {key}: {bad}")
    return df
