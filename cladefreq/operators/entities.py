"""Entity table: one cleaned row per id, its lineage groups and their sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.functions import clean_rank, lineage_rank, not_matching
from cladefreq.operators.joins import first_per_key, salted_join


def kept_entities(
    raw: DataFrame,
    order_by: Sequence[str],
    *,
    columns: Sequence[str] = (),
    key: str = "entity_id",
    lineage: str = "lineage",
    sentinel: str = presets.SENTINEL,
    excluded_domain: str = presets.EXCLUDED_DOMAIN,
) -> DataFrame:
    """First row of each id, then without unclassified and excluded-domain rows.

    The order matters: an id whose first row is unclassified is dropped even if
    a later copy has a lineage.
    """
    wanted = list(dict.fromkeys([key, lineage, *columns, *order_by]))
    first = first_per_key(raw.select(*wanted), [key], order_by)
    kept = first.where((F.col(lineage) != sentinel) & not_matching(F.col(lineage), excluded_domain))
    return kept.select(*dict.fromkeys([key, lineage, *columns]))


def with_groups(
    entities: DataFrame,
    *,
    lineage: str = "lineage",
    group_rank: int = presets.GROUP_RANK,
    group_prefix: str = presets.GROUP_PREFIX,
    subgroup_rank: int = presets.SUBGROUP_RANK,
    subgroup_prefix: str = presets.SUBGROUP_PREFIX,
) -> DataFrame:
    """Add ``group`` and ``subgroup`` read from the lineage."""

    def rank(number: int, prefix: str) -> Column:
        return clean_rank(lineage_rank(F.col(lineage), number), prefix)

    return entities.withColumns(
        {
            "group": rank(group_rank, group_prefix),
            "subgroup": rank(subgroup_rank, subgroup_prefix),
        }
    )


def clean_entities(raw: DataFrame, order_by: Sequence[str], **options) -> DataFrame:
    """``entity_id, lineage, group, subgroup`` of every kept entity."""
    return with_groups(kept_entities(raw, order_by, **options))


def group_sizes(entities: DataFrame, key: str, size: str) -> DataFrame:
    """Entities per group; a missing group is a group of its own."""
    return entities.groupBy(key).agg(F.count(F.lit(1)).alias(size))


def with_group_sizes(
    entities: DataFrame, keys: Sequence[str] = ("group", "subgroup"), *, key: str = "entity_id"
) -> DataFrame:
    """Attach ``<key>_size`` of each grouping to every entity.

    An aggregate joined back, not a window: a window would bring the largest
    group into one task. The sizes themselves say which groups are spread over
    how many places. All reads of the entities share their shuffle, and nothing
    runs before the result is asked for.
    """
    sized = entities
    for name in keys:
        sizes = group_sizes(entities, name, f"{name}_size")
        counts = sizes.withColumnRenamed(f"{name}_size", "n")
        sized = salted_join(sized, sizes, name, counts, how="left", spread=[key], null_matches=True)
    return sized


def entity_export(
    raw: DataFrame,
    order_by: Sequence[str],
    columns: Sequence[str],
    *,
    key: str = "entity_id",
    lineage: str = "lineage",
) -> DataFrame:
    """Listing of the kept entities with the chosen descriptive columns."""
    return kept_entities(raw, order_by, columns=columns, key=key, lineage=lineage).select(
        key, *columns, lineage
    )
