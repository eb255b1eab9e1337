"""Prevalence over all entities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.functions import percent_label, recode


def overall_prevalence(
    presence: DataFrame,
    entities: DataFrame,
    recoding: Mapping[str, str] | None = None,
    sentinel: str = presets.SENTINEL,
) -> DataFrame:
    """Percent of all kept entities, detected or not, that have each feature; sorted.

    A feature that is the sentinel for "no classification" is none. Recoding
    comes last, so features that get the same name keep rows of their own.
    """
    total = entities.agg(F.count(F.lit(1))).scalar()
    named = presence.where(F.col("feature") != sentinel)
    counted = named.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        recode(F.col("feature"), recoding).alias("feature"),
        (F.col("n") / total * 100).alias("pct"),
    ).orderBy(F.desc("pct"), "feature")


def bar_display(overall: DataFrame) -> DataFrame:
    """Features in bar order. One row per feature, so the ranking task is short."""
    order = W.orderBy(F.desc("pct"), "feature")
    return overall.select("feature", "pct", F.row_number().over(order).alias("bar_rank"))


def share_vs_rest(overall: DataFrame, feature: str, rest: str = "Other") -> DataFrame:
    """Share of entities with the feature and without it, with label texts."""
    share = overall.where(F.col("feature") == feature).agg(
        F.coalesce(F.max("pct"), F.lit(0.0)).alias("p")
    )
    slices = F.array(
        F.struct(F.lit(feature).alias("slice"), F.col("p").alias("pct")),
        F.struct(F.lit(rest).alias("slice"), (F.lit(100.0) - F.col("p")).alias("pct")),
    )
    return share.select(F.inline(slices)).select(
        "slice", "pct", percent_label(F.col("pct")).alias("label")
    )
