"""Dense prevalence grids: every seen group by every seen feature, zero-filled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.functions import not_in, recode
from cladefreq.operators.detections import class_columns
from cladefreq.operators.entities import group_sizes
from cladefreq.operators.joins import first_per_key, is_short, lookup_join
from cladefreq.operators.ranks import numbered
from cladefreq.sources.writers import written

MEASURES = ("max_per_entity", "n_with", "n_total")
#: Parts of the features that a group is filled up with one after the other, and copies of each part.
FEATURE_BUCKETS = 64
GROUP_PLACES = 32


def _cells(counted: DataFrame, group: str, feature: str) -> DataFrame:
    """Per group and feature: largest count of one entity, entities, sum of counts."""
    return counted.groupBy(group, feature).agg(
        F.max("n").alias("max_per_entity"),
        F.count_if(F.col("n") > 0).alias("n_with"),
        F.sum("n").alias("n_total"),
    )


def dense_grid(
    cells: DataFrame,
    group: str,
    feature: str,
    measures: Sequence[str] = MEASURES,
    *,
    buckets: int = FEATURE_BUCKETS,
    places: int = GROUP_PLACES,
) -> DataFrame:
    """Fill the cells up to seen groups x seen features, absent ones with zero.

    The size of the result is given by the question; no row, task or broadcast
    before it holds all features or all groups. Features are hashed into
    ``buckets``. Each group has one row per bucket, which folds its cells of that
    bucket into an array and unfolds it again with a zero for every feature of
    the bucket it lacks. The feature list of a bucket has ``places`` copies, and
    each group meets one of them.

    The lists read all measures, which keeps their plans equal to the cells' own:
    Spark then reuses their shuffle instead of repeating the work behind it.
    """
    held = reduce(Column.__and__, [F.col(f"_{m}") >= 0 for m in measures])

    def seen(key: str) -> DataFrame:
        return cells.groupBy(key).agg(*[F.sum(m).alias(f"_{m}") for m in measures]).where(held)

    # Structs, because a bare null (a type without a feature) would be skipped.
    bucket = F.pmod(F.xxhash64(F.struct(feature)), F.lit(buckets)).cast("int")
    place = F.pmod(F.xxhash64(F.struct(group)), F.lit(places)).cast("int")
    lists = seen(feature).withColumn("_bucket", bucket).groupBy("_bucket").agg(
        F.collect_list(F.struct(feature)).alias("_features")
    )
    lists = lists.select("_bucket", "_features", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("_place"))
    own = F.struct(feature, *measures)
    filled = cells.select(group, bucket.alias("_bucket"), own.alias("_cell"))
    empty = seen(group).select(
        group,
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"),
        F.lit(None).cast(filled.schema["_cell"].dataType).alias("_cell"),
    )
    folded = filled.unionByName(empty).groupBy(group, "_bucket").agg(F.collect_list("_cell").alias("_cells"))
    met = folded.withColumn("_place", place).join(lists, ["_bucket", "_place"])
    lacking = F.array_except(F.col("_features")[feature], F.col("_cells")[feature])
    zeros = F.transform(
        lacking,
        lambda f: F.struct(f.alias(feature), *[F.lit(0).cast("long").alias(m) for m in measures]),
    )
    return met.select(group, F.inline(F.concat("_cells", zeros)))


def _with_share(grid: DataFrame, entities: DataFrame, group: str) -> DataFrame:
    """Attach each group's size and the share of its entities, detected or not."""
    size = f"{group}_size"
    sizes = group_sizes(entities, group, size).withColumnRenamed(group, "_size_key")
    return (
        grid.join(sizes, grid[group].eqNullSafe(sizes["_size_key"]), "left")
        .drop("_size_key")
        .withColumn("share", F.col("n_with") / F.col(size))
    )


def feature_prevalence_by_group(
    enriched: DataFrame,
    entities: DataFrame,
    *,
    group: str = "group",
    exclude: Sequence[str] = presets.EXCLUDED_FEATURES,
    recoding: Mapping[str, str] | None = None,
) -> DataFrame:
    """Prevalence of every feature in every group that has a detected entity.

    Counts distinct types per entity. Types without a feature form a feature of
    their own (null). Excluded features are left out of the result, after they
    took part in deciding which groups are seen.
    """
    counted = (
        enriched.where(F.col("frequency") > 0)
        .groupBy("entity_id", group, "feature")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = dense_grid(_cells(counted, group, "feature"), group, "feature")
    kept = grid.where(not_in(F.col("feature"), exclude)).withColumn(
        "feature", recode(F.col("feature"), recoding)
    )
    return _with_share(kept, entities, group).select(
        group, f"{group}_size", "feature", "max_per_entity", "n_with", "n_total", "share"
    )


def first_class_per_merged_type(lookup: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The first lookup row of each merged type."""
    return first_per_key(lookup, ["merged_type"], order_by).select(
        "merged_type", "prediction", "type_group", "type_class"
    )


def type_prevalence_by_group(
    arrays: DataFrame,
    entities: DataFrame,
    lookup: DataFrame,
    lookup_order: Sequence[str],
    *,
    group: str = "group",
) -> DataFrame:
    """Prevalence of every merged type in every group with an array; counts arrays.

    Arrays are counted per entity and type before they meet the entities.
    """
    per_type = arrays.groupBy("entity_id", "feature_type").agg(F.count(F.lit(1)).alias("m"))
    located = per_type.join(entities.select("entity_id", group), "entity_id", "inner")
    short = is_short(lookup)
    merged = lookup_join(
        located, class_columns(lookup), "feature_type", spread=["entity_id"], short=short
    )
    counted = merged.groupBy("entity_id", group, "merged_type").agg(F.sum("m").alias("n"))
    grid = dense_grid(_cells(counted, group, "merged_type"), group, "merged_type")
    classes = first_class_per_merged_type(lookup, lookup_order)
    return lookup_join(
        _with_share(grid, entities, group), classes, "merged_type", spread=[group], short=short
    ).select(
        "merged_type",
        group,
        f"{group}_size",
        "n_with",
        "n_total",
        "share",
        "prediction",
        "type_group",
        "type_class",
    )


def type_totals(grid: DataFrame, *, group: str = "group") -> DataFrame:
    """Non-empty cells of the type grid."""
    return grid.where(F.col("n_total") > 0).select(group, "merged_type", "n_total", "type_class")


def type_distribution(totals: DataFrame) -> DataFrame:
    """Height of each type's stacked bar: its cells summed over the groups."""
    return totals.groupBy("merged_type", "type_class").agg(F.sum("n_total").alias("n_total"))


def heatmap_display(
    grid: DataFrame,
    *,
    group: str = "group",
    feature: str = "feature",
    facets: Sequence[str] = (),
    min_group_size: int | None = presets.MIN_GROUP_SIZE,
    rotate_above: int | None = presets.ROTATE_ABOVE,
) -> DataFrame:
    """Plot-ready grid: size cut, axis label, rank of the group by size, text angle.

    Groups rank by size, then name, by ranges of both, so neither many groups nor
    many of one size are one task's work. ``facets`` are columns of the grid that
    the panels are cut by; without ``rotate_above`` no text is turned and there is
    no angle column.
    """
    size = f"{group}_size"
    shown = written(grid if min_group_size is None else grid.where(F.col(size) > min_group_size))
    groups = shown.select(F.col(group).alias("_g"), F.col(size).alias("_size")).distinct()
    ranked = numbered(groups, [F.col("_size"), F.col("_g").asc_nulls_first()]).select(
        "_g", (F.col("pos") + 1).cast("long").alias("display_rank")
    )
    label = F.concat(
        F.coalesce(F.col(group), F.lit("NA")), F.lit("\n"), F.col(size).cast("string")
    )
    angle = []
    if rotate_above is not None:
        angle = [F.when(F.col("n_with") > rotate_above, 90).otherwise(0).alias("text_angle")]
    return shown.join(ranked, F.col(group).eqNullSafe(F.col("_g"))).select(
        group,
        size,
        feature,
        *facets,
        "n_with",
        "share",
        label.alias("axis_label"),
        "display_rank",
        *angle,
    )
