"""The three analyses end to end, from raw tables to named result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.operators import components, detections, entities, grid, lookups, matrix
from cladefreq.operators import overall as shares
from cladefreq.operators import sets as overlaps
from cladefreq.sources.readers import ORDER_COLUMNS
from cladefreq.sources.writers import publish, written


def type_report(
    raw_entities: DataFrame,
    raw_arrays: DataFrame,
    class_lookup: DataFrame,
    *,
    entity_order: Sequence[str] = ORDER_COLUMNS,
    lookup_order: Sequence[str] = ORDER_COLUMNS,
) -> dict[str, DataFrame]:
    """Array types by group: listing, grid, totals and display tables."""
    lookups.require_unique(class_lookup, "prediction")
    cleaned = written(entities.clean_entities(raw_entities, entity_order))
    arrays = detections.array_detections(raw_arrays)
    by_group = grid.type_prevalence_by_group(arrays, cleaned, class_lookup, lookup_order)
    totals = grid.type_totals(by_group)
    return {
        "typed_detections": detections.typed_detections(
            arrays, entities.with_group_sizes(cleaned, ["group"]), class_lookup
        ),
        "type_prevalence_by_group": by_group,
        "type_totals": totals,
        "type_distribution": grid.type_distribution(totals),
        "type_heatmap": grid.heatmap_display(
            by_group,
            feature="merged_type",
            facets=("type_class", "type_group"),
            min_group_size=None,
            rotate_above=None,
        ),
    }


def feature_report(
    raw_entities: DataFrame,
    raw_evidence: DataFrame,
    raw_arrays: DataFrame,
    feature_lookup: DataFrame,
    root: str,
    *,
    entity_order: Sequence[str] = ORDER_COLUMNS,
    sets: Mapping[str, Sequence[str]] = presets.VENN_SETS,
    exclude: Sequence[str] = presets.EXCLUDED_FEATURES,
    recoding: Mapping[str, str] | None = presets.FEATURE_RECODE,
    share_feature: str = presets.SHARE_FEATURE,
) -> dict[str, DataFrame]:
    """Features by group, by subgroup and overall, with overlaps and display tables.

    All other tables read the enriched detections, so these are published below
    ``root`` first and read back: the work behind them runs once and its lineage
    ends there.
    """
    spark = raw_entities.sparkSession
    lookups.require_unique(feature_lookup, "feature_type")
    cleaned = entities.clean_entities(raw_entities, entity_order)
    evidence = detections.evidence_detections(detections.evidence_rows(raw_evidence))
    counts = detections.count_types(evidence, detections.array_detections(raw_arrays))
    sized = written(entities.with_group_sizes(written(cleaned)))
    stored = publish(
        {"detections_enriched": detections.detections_enriched(counts, sized, feature_lookup)},
        root,
    )
    enriched = spark.read.parquet(stored["detections_enriched"])
    options = {"exclude": exclude, "recoding": recoding}
    by_group = grid.feature_prevalence_by_group(enriched, sized, **options)
    by_subgroup = grid.feature_prevalence_by_group(enriched, sized, group="subgroup", **options)
    presence = enriched_presence(enriched, exclude=exclude, recoding=recoding)
    prevalence = shares.overall_prevalence(
        enriched_presence(enriched, exclude=exclude), sized, recoding
    )
    return {
        "detections_enriched": enriched,
        "feature_prevalence_by_group": by_group,
        "feature_prevalence_by_subgroup": by_subgroup,
        "group_heatmap": grid.heatmap_display(by_group),
        "subgroup_heatmap": grid.heatmap_display(by_subgroup, group="subgroup"),
        "feature_prevalence_overall": prevalence,
        "feature_bars": shares.bar_display(prevalence),
        "share_vs_rest": shares.share_vs_rest(prevalence, share_feature),
        "set_membership": overlaps.set_membership(presence, sets),
        "set_overlap_regions": overlaps.set_overlap_regions(presence, sets),
    }


def enriched_presence(
    enriched: DataFrame,
    *,
    exclude: Sequence[str] = presets.EXCLUDED_FEATURES,
    recoding: Mapping[str, str] | None = None,
) -> DataFrame:
    """Distinct (entity, feature) of an enriched table."""
    named = enriched.where(
        F.col("feature").isNotNull() & detections.not_in(F.col("feature"), exclude)
    )
    return named.select(
        "entity_id", detections.recode(F.col("feature"), recoding).alias("feature")
    ).distinct()


def supplementary_report(
    raw_entities: DataFrame,
    raw_evidence: DataFrame,
    raw_arrays: DataFrame,
    feature_lookup: DataFrame,
    *,
    entity_order: Sequence[str] = ORDER_COLUMNS,
    export_columns: Sequence[str] = presets.ENTITY_EXPORT_COLUMNS[1:-1],
    exclude: Sequence[str] = presets.EXCLUDED_FEATURES,
    recoding: Mapping[str, str] | None = presets.FEATURE_RECODE,
) -> dict[str, DataFrame]:
    """Entity and pattern-subset listings, presence matrices and components."""
    lookups.require_unique(feature_lookup, "feature_type")
    cleaned = written(entities.clean_entities(raw_entities, entity_order))
    sized = written(entities.with_group_sizes(cleaned))
    rows = detections.evidence_rows(raw_evidence)
    argonaute = detections.named_or_matching(
        "protein_name", presets.ARGONAUTE_PATTERN, presets.ARGONAUTE_NAME
    )
    retron = F.col("feature_type").rlike(presets.RETRON_TYPE_PATTERN) & F.col(
        "protein_name"
    ).rlike(presets.RETRON_PROTEIN_PATTERN)
    listing = [c for c in ("gtdb", *ORDER_COLUMNS) if c in raw_evidence.columns]
    pairs = detections.feature_pairs(
        [rows, detections.array_detections(raw_arrays)],
        feature_lookup,
        exclude=exclude,
        recoding=recoding,
    )
    sets = written(matrix.size_cut_sets(pairs, sized))
    covariance = written(components.feature_covariance(matrix.pruned_sets(sets)))
    return {
        "table_entities": entities.entity_export(raw_entities, entity_order, export_columns),
        "table_argonaute": detections.evidence_subset(
            rows, cleaned, argonaute, ORDER_COLUMNS
        ).drop(*listing),
        "table_retron": detections.evidence_subset(rows, cleaned, retron, ORDER_COLUMNS).drop(
            *listing
        ),
        "presence_matrix": matrix.presence_matrix(pairs, sized),
        "presence_matrix_totals": matrix.matrix_with_totals(pairs, sized),
        "presence_matrix_pruned": matrix.pruned_matrix(sets),
        "feature_covariance": covariance.drop("n_rows"),
        "pca_variance": components.variance_table(covariance),
        "pca_variable_map": components.variable_map(covariance),
    }
