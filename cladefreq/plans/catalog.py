"""One query per analysis, over the star tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladefreq.operators import components, detections, entities, grid, lookups, matrix
from cladefreq.operators import overall as shares
from cladefreq.operators import sets as overlaps
from cladefreq.operators.joins import first_per_key
from cladefreq.plans import star_views as views
from cladefreq.plans import text_views as texts
from cladefreq.sources import (
    fingerprint,
    header_names,
    publish,
    published,
    read_arrays,
    read_class_lookup,
    read_entities,
    read_evidence,
    read_feature_lookup,
    read_published,
    read_text_table,
    shared_folder,
    written,
)
from cladefreq.sources.readers import EVIDENCE_NUMBERS, ORDER_COLUMNS

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Star:
    """The intermediate tables the queries are composed of, each built once.

    Tables that are read more than once are stored; the rest is lazy.
    """

    spark: SparkSession
    sf_dir: str

    @cached_property
    def raw_entities(self) -> DataFrame:
        return views.raw_entities(self.spark, self.sf_dir)

    @cached_property
    def entities(self) -> DataFrame:
        """Read by sizes, denominators and joins, which share its shuffle."""
        return entities.clean_entities(self.raw_entities, views.ENTITY_ORDER)

    @cached_property
    def sized(self) -> DataFrame:
        return entities.with_group_sizes(self.entities)

    @cached_property
    def evidence(self) -> DataFrame:
        raw = views.raw_evidence(self.spark, self.sf_dir)
        return detections.evidence_rows(raw, **views.EVIDENCE_CUTS)

    @cached_property
    def arrays(self) -> DataFrame:
        return detections.array_detections(views.raw_arrays(self.spark, self.sf_dir))

    @cached_property
    def features(self) -> DataFrame:
        return views.feature_lookup(self.spark, self.sf_dir)

    @cached_property
    def classes(self) -> DataFrame:
        return views.class_lookup(self.spark)

    @cached_property
    def counts(self) -> DataFrame:
        return detections.count_types(
            detections.evidence_detections(self.evidence), self.arrays
        )

    def enriched(self, with_entities: DataFrame) -> DataFrame:
        return detections.detections_enriched(self.counts, with_entities, self.features)

    @cached_property
    def pairs(self) -> DataFrame:
        return self.pairs_as(views.RECODING)

    def pairs_as(self, recoding) -> DataFrame:
        return detections.feature_pairs(
            [self.evidence, self.arrays],
            self.features,
            exclude=views.EXCLUDED,
            recoding=recoding,
        )

    @cached_property
    def presence(self) -> DataFrame:
        return detections.feature_presence(self.pairs, self.entities)

    @cached_property
    def overall(self) -> DataFrame:
        present = detections.feature_presence(self.pairs_as(None), self.entities)
        return shares.overall_prevalence(present, self.entities, views.RECODING)

    @cached_property
    def type_grid(self) -> DataFrame:
        return grid.type_prevalence_by_group(
            self.arrays, self.entities, self.classes, views.LOOKUP_ORDER
        )

    def feature_grid(self, group: str) -> DataFrame:
        return grid.feature_prevalence_by_group(
            self.enriched(self.entities.select("entity_id", group)),
            self.entities,
            group=group,
            exclude=views.EXCLUDED,
            recoding=views.RECODING,
        )

    @cached_property
    def cut_sets(self) -> DataFrame:
        """Stored: pair counts, totals and sizes all read it, and the plans behind it would add up on the driver."""
        sized = entities.with_group_sizes(self.entities, ["subgroup"])
        return written(matrix.size_cut_sets(self.pairs, sized))

    @cached_property
    def covariance(self) -> DataFrame:
        return components.feature_covariance(matrix.pruned_sets(self.cut_sets))


def entity_clean(star: Star) -> DataFrame:
    return star.sized


def entity_export(star: Star) -> DataFrame:
    return entities.entity_export(star.raw_entities, views.ENTITY_ORDER, views.ENTITY_COLUMNS)


def evidence_detections(star: Star) -> DataFrame:
    return detections.evidence_detections(star.evidence)


def _subset(star: Star, condition) -> DataFrame:
    rows = detections.evidence_subset(
        star.evidence, star.entities, condition, views.EVIDENCE_ORDER
    )
    return rows.drop(*views.EVIDENCE_ORDER)


def evidence_subset_regex(star: Star) -> DataFrame:
    return _subset(
        star,
        detections.named_or_matching("protein_name", views.PROTEIN_PATTERN, views.PROTEIN_NAME),
    )


def evidence_subset_prefix(star: Star) -> DataFrame:
    return _subset(
        star,
        F.col("feature_type").rlike(views.TYPE_PREFIX)
        & F.col("protein_name").rlike(views.PROTEIN_PREFIX),
    )


def array_detections(star: Star) -> DataFrame:
    return star.arrays


def typed_detections(star: Star) -> DataFrame:
    sized = entities.with_group_sizes(star.entities, ["group"])
    return detections.typed_detections(star.arrays, sized, star.classes)


def type_prevalence_by_group(star: Star) -> DataFrame:
    return star.type_grid


def type_totals(star: Star) -> DataFrame:
    return grid.type_totals(star.type_grid)


def type_distribution(star: Star) -> DataFrame:
    return grid.type_distribution(grid.type_totals(star.type_grid))


def detections_enriched(star: Star) -> DataFrame:
    return star.enriched(star.sized)


def feature_prevalence_by_group(star: Star) -> DataFrame:
    return star.feature_grid("group")


def feature_prevalence_by_subgroup(star: Star) -> DataFrame:
    return star.feature_grid("subgroup")


def feature_prevalence_overall(star: Star) -> DataFrame:
    return star.overall


def feature_bars(star: Star) -> DataFrame:
    return shares.bar_display(star.overall)


def share_vs_rest(star: Star) -> DataFrame:
    return shares.share_vs_rest(star.overall, views.SHARE_FEATURE)


def set_membership(star: Star) -> DataFrame:
    return overlaps.set_membership(star.presence, views.SETS)


def set_overlap_regions(star: Star) -> DataFrame:
    return overlaps.set_overlap_regions(star.presence, views.SETS)


def presence_matrix(star: Star) -> DataFrame:
    return matrix.presence_matrix(star.pairs, star.sized)


def presence_matrix_totals(star: Star) -> DataFrame:
    sized = entities.with_group_sizes(star.entities, ["subgroup"])
    return matrix.matrix_with_totals(star.pairs, sized)


def presence_matrix_pruned(star: Star) -> DataFrame:
    return matrix.pruned_presence(star.cut_sets)


def group_heatmap(star: Star) -> DataFrame:
    return grid.heatmap_display(star.feature_grid("group"))


def subgroup_heatmap(star: Star) -> DataFrame:
    return grid.heatmap_display(star.feature_grid("subgroup"), group="subgroup")


def type_heatmap(star: Star) -> DataFrame:
    return grid.heatmap_display(
        star.type_grid,
        feature="merged_type",
        facets=("type_class", "type_group"),
        min_group_size=None,
        rotate_above=None,
    )


def feature_covariance(star: Star) -> DataFrame:
    rounded = F.round("covariance", 12).alias("covariance")
    return star.covariance.select("feature_a", "feature_b", rounded)


def _rounded(table: DataFrame) -> DataFrame:
    """Numbers of an iteration to nine digits, without a negative zero."""
    numbers = [f.name for f in table.schema.fields if f.dataType.simpleString() == "double"]
    return table.withColumns({c: F.round(c, 9) + 0.0 for c in numbers})


def pca_variance(star: Star) -> DataFrame:
    return _rounded(components.variance_table(star.covariance))


def pca_variable_map(star: Star) -> DataFrame:
    return _rounded(components.variable_map(star.covariance))


def lookup_key_check(star: Star) -> DataFrame:
    reports = [
        lookups.key_report(star.features, "feature_type", "feature_lookup"),
        lookups.key_report(star.classes, "prediction", "class_lookup"),
        lookups.key_report(star.classes, "merged_type", "class_lookup_merged"),
        lookups.key_report(star.raw_entities, "entity_id", "raw_entities"),
        lookups.key_report(star.entities, "entity_id", "entities"),
    ]
    return reduce(DataFrame.unionByName, reports)


#: Result tables as text, and listings that are sheets of one collection.
CSV_TABLES = (
    "typed_detections",
    "detections_enriched",
    "feature_prevalence_by_group",
    "feature_prevalence_by_subgroup",
    "feature_prevalence_overall",
)


def publish_tables(star: Star) -> DataFrame:
    """Publish the eight result tables and read them back by the manifest: one row each."""
    tables = {
        "typed_detections": typed_detections(star),
        "detections_enriched": detections_enriched(star),
        "feature_prevalence_by_group": feature_prevalence_by_group(star),
        "feature_prevalence_by_subgroup": feature_prevalence_by_subgroup(star),
        "feature_prevalence_overall": star.overall,
        "entity_export": entity_export(star),
        "evidence_subset_regex": evidence_subset_regex(star),
        "evidence_subset_prefix": evidence_subset_prefix(star),
    }
    root = shared_folder(star.spark)
    publish(tables, root, fmt=dict.fromkeys(CSV_TABLES, "csv"))
    listed = published(star.spark, root).select("table_name", "file_format")
    marks = [
        fingerprint(read_published(star.spark, root, name)).select(F.lit(name).alias("_name"), "n_rows", "checksum")
        for name in tables
    ]
    found = reduce(DataFrame.unionByName, marks)
    return listed.join(found, F.col("table_name") == F.col("_name")).drop("_name")


def text_entities(star: Star) -> DataFrame:
    """First row of each id in file order, from a tab-separated file."""
    raw = read_entities(star.spark, texts.entity_file(star.spark, star.sf_dir))
    return entities.entity_export(raw, ORDER_COLUMNS, ("source_name", "segment", "home", "area"))


def text_arrays(star: Star) -> DataFrame:
    """Array detections from the ragged file."""
    return detections.array_detections(read_arrays(star.spark, texts.array_file(star.spark, star.sf_dir)))


def text_evidence(star: Star) -> DataFrame:
    """First row of each locus in file order among those that pass the cuts, from a comma-separated file."""
    raw = read_evidence(star.spark, texts.evidence_file(star.spark, star.sf_dir))
    kept = detections.evidence_rows(raw, **views.EVIDENCE_CUTS)
    first = first_per_key(kept, detections.LOCUS_KEYS, ORDER_COLUMNS)
    return first.select(
        "entity_id",
        "feature_type",
        F.col("locus_number").cast("int").alias("locus_number"),
        "protein_name",
        *EVIDENCE_NUMBERS,
    )


def text_lookups(star: Star) -> DataFrame:
    """Both lookups from tab-separated files; of the classes, the first row of each merged type."""
    features, classes = texts.lookup_files(star.spark, star.sf_dir)
    first = grid.first_class_per_merged_type(read_class_lookup(star.spark, classes), ORDER_COLUMNS)
    return (
        read_feature_lookup(star.spark, features)
        .select(F.lit("features").alias("table_name"), F.col("feature_type").alias("key"), F.col("feature").alias("value"))
        .unionByName(
            first.select(F.lit("classes").alias("table_name"), F.col("merged_type").alias("key"), F.col("prediction").alias("value"))
        )
    )


def text_columns(star: Star) -> DataFrame:
    """Names in the first lines of the text files, and how many cells below them are filled."""
    entity_path = texts.entity_file(star.spark, star.sf_dir)
    evidence_path = texts.evidence_file(star.spark, star.sf_dir)
    files = (("entities", entity_path, "\t"), ("evidence", evidence_path, ","))
    found = []
    for name, path, sep in files:
        names = header_names(star.spark, path, sep=sep)
        raw = read_text_table(star.spark, path, sep=sep, columns=names, na="NA")
        found.append(texts.filled_cells(raw, name))
    return reduce(DataFrame.unionByName, found)


ANALYSES: tuple[Callable[[Star], DataFrame], ...] = (
    entity_clean,
    entity_export,
    evidence_detections,
    evidence_subset_regex,
    evidence_subset_prefix,
    array_detections,
    typed_detections,
    type_prevalence_by_group,
    type_totals,
    type_distribution,
    detections_enriched,
    feature_prevalence_by_group,
    feature_prevalence_by_subgroup,
    feature_prevalence_overall,
    feature_bars,
    share_vs_rest,
    set_membership,
    set_overlap_regions,
    presence_matrix,
    presence_matrix_totals,
    presence_matrix_pruned,
    group_heatmap,
    subgroup_heatmap,
    type_heatmap,
    feature_covariance,
    pca_variance,
    pca_variable_map,
    lookup_key_check,
    publish_tables,
    text_entities,
    text_arrays,
    text_evidence,
    text_lookups,
    text_columns,
)


def _query(analysis: Callable[[Star], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return analysis(Star(spark, sf_dir))

    run.__name__ = analysis.__name__
    return run


def all_queries() -> dict[str, Query]:
    return {analysis.__name__: _query(analysis) for analysis in ANALYSES}
