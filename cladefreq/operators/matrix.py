"""Presence matrices: sorted feature sets inside, one column per feature only at the edge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.operators.grid import FEATURE_BUCKETS, GROUP_PLACES

GROUP_COLUMNS = ("group", "group_size", "subgroup", "subgroup_size")


def feature_sets(pairs: DataFrame, entities: DataFrame, columns: Sequence[str] = GROUP_COLUMNS) -> DataFrame:
    """One row per kept entity: the chosen columns and its ``features``, distinct and sorted.

    Repeated pairs are removed on the map side; entities without a feature have
    an empty array. This is the whole matrix in its sparse form, for any number
    of features.
    """
    sets = pairs.groupBy("entity_id").agg(F.sort_array(F.collect_set("feature")).alias("features"))
    joined = entities.select("entity_id", *columns).join(sets, "entity_id", "left")
    nothing = F.array().cast("array<string>")
    return joined.withColumn("features", F.coalesce("features", nothing))


def size_cut_sets(
    pairs: DataFrame, sized_entities: DataFrame, min_group_size: int = presets.MIN_GROUP_SIZE
) -> DataFrame:
    """``entity_id, subgroup, features`` of entities in large enough subgroups.

    Entities without any feature have no row here, which is the row-total cut.
    """
    large = sized_entities.where(F.col("subgroup_size") > min_group_size)
    sets = feature_sets(pairs, large, ["subgroup"])
    return sets.where(F.size("features") > 0)


def feature_totals(sets: DataFrame) -> DataFrame:
    """Entities that have each feature."""
    return (
        sets.select(F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("feature_total"))
    )


def frequent_features(
    sets: DataFrame, min_feature_total: int = presets.MIN_FEATURE_TOTAL
) -> DataFrame:
    """Features present in more than ``min_feature_total`` entities."""
    return feature_totals(sets).where(F.col("feature_total") > min_feature_total)


def feature_dictionary(features: DataFrame, taken: Sequence[str] = ()) -> dict[str, str]:
    """Column name of each feature in a wide table, in name order; this collects the names.

    A name is used as it is, whatever characters it has, unless a column in
    ``taken`` or a feature before it has the same name up to case, which a table
    cannot hold twice: then ``_2``, ``_3`` and so on is added.
    """
    names = sorted(r[0] for r in features.select("feature").distinct().collect())
    used, out = {t.lower() for t in taken}, {}
    for name in names:
        column, n = name, 1
        while column.lower() in used:
            n += 1
            column = f"{name}_{n}"
        used.add(column.lower())
        out[name] = column
    return out


def _flag(name: str) -> Column:
    return F.array_contains("features", F.lit(name)).cast("int")


def wide(sets: DataFrame, dictionary: Mapping[str, str]) -> DataFrame:
    """The sets with a 0/1 column per feature of the dictionary in place of the array."""
    rest = [F.col(c) for c in sets.columns if c != "features"]
    return sets.select(*rest, *[_flag(name).alias(column) for name, column in dictionary.items()])


def presence_matrix(
    pairs: DataFrame,
    entities: DataFrame,
    columns: Sequence[str] = GROUP_COLUMNS,
) -> DataFrame:
    """0/1 per kept entity and feature found, with the entity's group columns.

    Entities without a feature are rows of zeros.
    """
    return wide(
        feature_sets(pairs, entities, columns), feature_dictionary(pairs, ["entity_id", *columns])
    )


def matrix_with_totals(
    pairs: DataFrame,
    sized_entities: DataFrame,
    *,
    min_group_size: int = presets.MIN_GROUP_SIZE,
    total_label: str = "fam_sum",
) -> DataFrame:
    """Matrix of the large subgroups, a row total per entity, and one row of column sums.

    Rows and sums are two grouping sets of one pass over the feature sets. The
    sums are there even if no entity is; a row without values stands in for them
    and is left out again.
    """
    keys = ["entity_id", "subgroup"]
    names = feature_dictionary(pairs, [*keys, "row_total"])
    large = sized_entities.where(F.col("subgroup_size") > min_group_size)
    sets = feature_sets(pairs, large, ["subgroup"]).withColumn("_is_row", F.lit(1))
    nothing = sets.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("subgroup"),
        F.array().cast("array<string>").alias("features"),
        F.lit(0).alias("_is_row"),
    )
    # Positions stand for the names until the end, so no name can clash with a key.
    flags = {f"_{i}": name for i, name in enumerate(names)}
    flagged = sets.unionByName(nothing).select(
        *keys, "_is_row", F.size("features").alias("_total"), *[_flag(n).alias(i) for i, n in flags.items()]
    )
    numbers = [*flags, "_total"]
    summed = flagged.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_grouping"),
        F.max("_is_row").alias("_is_row"),
        *[F.sum(c).cast("long").alias(c) for c in numbers],
    )
    is_total = F.col("_grouping") > 0
    return summed.where(is_total | (F.col("_is_row") > 0)).select(
        "entity_id",
        F.when(is_total, F.lit(total_label)).otherwise(F.col("subgroup")).alias("subgroup"),
        *[F.col(i).alias(names[name]) for i, name in flags.items()],
        F.col("_total").alias("row_total"),
    )


def pruned_sets(
    sets: DataFrame, min_feature_total: int = presets.MIN_FEATURE_TOTAL
) -> DataFrame:
    """The sets without infrequent features.

    An entity whose features are all infrequent stays with an empty set: the row
    cut looks at totals over all features.
    """
    kept = frequent_features(sets, min_feature_total).withColumnRenamed("feature", "_kept")
    each = sets.select("entity_id", "subgroup", F.explode("features").alias("feature"))
    flagged = each.join(kept.select("_kept"), F.col("feature") == F.col("_kept"), "left")
    return flagged.groupBy("entity_id", "subgroup").agg(
        F.sort_array(F.collect_list("_kept")).alias("features")
    )


def pruned_matrix(
    sets: DataFrame, min_feature_total: int = presets.MIN_FEATURE_TOTAL
) -> DataFrame:
    """Wide 0/1 matrix over the frequent features."""
    kept = frequent_features(sets, min_feature_total)
    return wide(
        pruned_sets(sets, min_feature_total), feature_dictionary(kept, ["entity_id", "subgroup"])
    )


def pruned_presence(
    sets: DataFrame, min_feature_total: int = presets.MIN_FEATURE_TOTAL
) -> DataFrame:
    """The pruned matrix in long form: entity, subgroup, feature, 0 or 1.

    Entities times frequent features, as asked for. Each entity has a row per
    bucket of features with its own of that bucket, and meets the bucket's list.
    """
    kept = frequent_features(sets, min_feature_total)
    bucket = F.pmod(F.xxhash64("feature"), F.lit(FEATURE_BUCKETS)).cast("int")
    lists = kept.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.collect_list("feature").alias("_list"))
    lists = lists.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(GROUP_PLACES - 1))))
    spread = sets.select(
        "entity_id",
        "subgroup",
        F.col("features").alias("_own"),
        F.pmod(F.xxhash64("entity_id"), F.lit(GROUP_PLACES)).cast("int").alias("_place"),
        F.explode(F.sequence(F.lit(0), F.lit(FEATURE_BUCKETS - 1))).alias("_bucket"),
    )
    in_bucket = F.filter("_own", lambda f: F.pmod(F.xxhash64(f), F.lit(FEATURE_BUCKETS)) == F.col("_bucket"))
    met = spread.withColumn("features", in_bucket).drop("_own").join(lists, ["_bucket", "_place"])
    return met.select(
        "entity_id",
        "subgroup",
        F.inline(
            F.transform(
                "_list",
                lambda f: F.struct(
                    f.alias("feature"), F.array_contains("features", f).cast("int").alias("present")
                ),
            )
        ),
    )
