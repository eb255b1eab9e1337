"""Sets of entities defined by features, and how they overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cladefreq import presets

Sets = Mapping[str, Sequence[str]]


def set_membership(presence: DataFrame, sets: Sets = presets.VENN_SETS) -> DataFrame:
    """Distinct (set, entity): the entity has at least one feature of the set."""
    names = F.array(
        *[
            F.when(F.col("feature").isin(list(features)), F.lit(name))
            for name, features in sets.items()
        ]
    )
    return presence.select(
        F.explode(F.array_compact(names)).alias("set_name"), "entity_id"
    ).distinct()


def _union_bits(bits: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def set_overlap_regions(presence: DataFrame, sets: Sets = presets.VENN_SETS) -> DataFrame:
    """Entities per exact combination of sets, empty combinations included.

    Percentages are of the entities in at least one set. Each entity is folded
    to one bit mask, so the counts need two aggregations whatever the set sizes.
    """
    names = list(sets)
    bits = _union_bits(
        [
            F.when(F.col("feature").isin(list(features)), F.lit(1 << i)).otherwise(F.lit(0))
            for i, features in enumerate(sets.values())
        ]
    )
    masks = presence.groupBy("entity_id").agg(F.bit_or(bits).alias("mask"))
    counted = masks.where("mask > 0").groupBy("mask").agg(F.count(F.lit(1)).alias("_n"))
    # 2^k - 1 rows from here on.
    regions = presence.sparkSession.range(1, 1 << len(names)).select(
        F.col("id").cast("int").alias("mask")
    )
    member = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(n)) for i, n in enumerate(names)]
    filled = regions.join(counted, "mask", "left").withColumn(
        "n_entities", F.coalesce("_n", F.lit(0))
    )
    return filled.select(
        F.concat_ws(" & ", *member).alias("region"),
        F.bit_count("mask").alias("n_sets"),
        "n_entities",
        (F.col("n_entities") * 100 / F.sum("n_entities").over(W.partitionBy())).alias("pct"),
    )
