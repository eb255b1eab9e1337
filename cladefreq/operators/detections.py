"""Detections: thresholds, repairs, union of sources, enrichment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.functions import first_piece, not_in, recode
from cladefreq.operators.joins import first_per_key, hot_key_join, lookup_join

LOCUS_KEYS = ("entity_id", "feature_type", "locus_number")


def evidence_rows(
    raw: DataFrame,
    *,
    max_full_e: float = presets.MAX_E_VALUE,
    max_domain_e: float = presets.MAX_E_VALUE,
    min_target_coverage: float = presets.MIN_COVERAGE,
    min_hmm_coverage: float = presets.MIN_COVERAGE,
) -> DataFrame:
    """Rows that pass both E-value and both coverage thresholds (all strict)."""
    return raw.where(
        (F.col("full_seq_e_value") < max_full_e)
        & (F.col("domain_ie_value") < max_domain_e)
        & (F.col("target_coverage") > min_target_coverage)
        & (F.col("hmm_coverage") > min_hmm_coverage)
    )


def evidence_detections(rows: DataFrame) -> DataFrame:
    """One (entity, type) row per distinct locus; loci of the same type repeat the pair."""
    return rows.select(*LOCUS_KEYS).distinct().select("entity_id", "feature_type")


def named_or_matching(name: str, pattern: str, exact: str) -> Column:
    """Condition "matches the pattern, or is exactly this name"."""
    return F.col(name).rlike(pattern) | (F.col(name) == exact)


def evidence_subset(
    rows: DataFrame, entities: DataFrame, condition: Column, order_by: Sequence[str]
) -> DataFrame:
    """First full row of each locus among the rows meeting ``condition``, with the
    entity's lineage attached; rows of unknown entities stay, without a lineage."""
    chosen = rows.where(condition)
    first = first_per_key(chosen, LOCUS_KEYS, order_by)
    return hot_key_join(
        first,
        entities.select("entity_id", "lineage"),
        "entity_id",
        how="left",
        spread=["feature_type", "locus_number"],
        counted=chosen,
    )


def repair_arrays(raw: DataFrame) -> DataFrame:
    """Undo the one-cell shift of the merged array file.

    Id and contig share the first cell, so every later cell sits one column too
    far left and the last column is empty. Header lines repeat inside the file
    and are dropped before anything is cast.
    """
    names = list(raw.columns)
    first, rest = F.col(names[0]), names[1:-1]
    pieces = F.split(first, " ")
    body = raw.where(~F.coalesce(first.contains(names[0]), F.lit(False)))
    return body.select(
        first_piece(first, " ").alias(names[0]),
        F.get(pieces, 1).alias(names[1]),
        *[F.col(old).alias(new) for old, new in zip(rest, names[2:])],
    )


def array_detections(
    raw: DataFrame, *, min_probability: float = presets.MIN_PROBABILITY
) -> DataFrame:
    """Repaired array detections whose type call passes the probability cut.

    ``raw`` has the columns of ``presets.ARRAY_COLUMNS``, all text. The version
    after the first dot of the id is dropped; not every id has one.
    """
    fixed = repair_arrays(raw)
    number = F.expr("try_cast(Subtype_probability AS double)")
    return (
        fixed.select(
            first_piece(F.col("AccessionID"), ".").alias("entity_id"),
            F.col("Contig").alias("contig"),
            F.col("CRISPR").alias("array_id"),
            F.col("Prediction").alias("prediction"),
            F.col("Subtype").alias("feature_type"),
            number.alias("probability"),
        )
        .where(F.col("probability") > min_probability)
    )


def class_columns(lookup: DataFrame) -> DataFrame:
    """Lookup ``prediction -> merged_type, type_group, type_class`` keyed for joins."""
    return lookup.select(
        F.col("prediction").alias("feature_type"), "merged_type", "type_group", "type_class"
    )


def typed_detections(arrays: DataFrame, entities: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row per array of a kept entity, with its group and its type's class."""
    located = hot_key_join(
        arrays.select("entity_id", "feature_type", "array_id"),
        entities.select("entity_id", "group", "group_size"),
        "entity_id",
        how="inner",
        spread=["array_id"],
    )
    classed = lookup_join(
        located, class_columns(lookup), "feature_type", spread=["entity_id", "array_id"]
    )
    return classed.select(
        "group",
        "group_size",
        "entity_id",
        F.col("feature_type").alias("raw_type"),
        "merged_type",
        "type_group",
        "type_class",
    )


def count_types(*sources: DataFrame) -> DataFrame:
    """Append the sources, duplicates kept, and count rows per (entity, type)."""
    pairs = [s.select("entity_id", "feature_type") for s in sources]
    return (
        reduce(DataFrame.unionByName, pairs)
        .groupBy("entity_id", "feature_type")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def detections_enriched(
    counts: DataFrame,
    entities: DataFrame,
    lookup: DataFrame,
    recoding: Mapping[str, str] | None = None,
) -> DataFrame:
    """Every kept entity with its counted types and their features.

    Entities without a detection stay, with nulls. The counts were aggregated
    before this join, so an entity with very many detections brings one row per
    type, not one per detection.
    """
    joined = counts.join(entities, "entity_id", "right")
    named = lookup_join(
        joined, lookup.select("feature_type", "feature"), "feature_type", spread=["entity_id"]
    )
    rest = [c for c in entities.columns if c != "entity_id"]
    return named.select(
        "entity_id",
        "feature_type",
        "frequency",
        *rest,
        recode(F.col("feature"), recoding).alias("feature"),
    )


def feature_pairs(
    sources: Sequence[DataFrame],
    lookup: DataFrame,
    *,
    exclude: Sequence[str] = presets.EXCLUDED_FEATURES,
    recoding: Mapping[str, str] | None = None,
) -> DataFrame:
    """(entity, feature) rows of all sources, repeats allowed.

    Types without a feature and excluded features are dropped.
    """
    pairs = reduce(
        DataFrame.unionByName, [s.select("entity_id", "feature_type") for s in sources]
    )
    names = lookup.select("feature_type", "feature")
    named = lookup_join(pairs, names, "feature_type", spread=["entity_id"])
    return named.where(F.col("feature").isNotNull() & not_in(F.col("feature"), exclude)).select(
        "entity_id", recode(F.col("feature"), recoding).alias("feature")
    )


def feature_presence(
    pairs: DataFrame, entities: DataFrame, columns: Sequence[str] = ()
) -> DataFrame:
    """Distinct (entity, feature) of kept entities, plus chosen entity columns.

    The distinct runs first: its map side removes an entity's repeats before
    anything is shuffled for the join.
    """
    present = pairs.select("entity_id", "feature").distinct()
    return present.join(entities.select("entity_id", *columns), "entity_id", "inner")
