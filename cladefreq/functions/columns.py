from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cladefreq import presets


def lineage_rank(lineage: Column, rank: int) -> Column:
    """The 1-based ``rank`` of a ``;``-separated lineage; null if it has fewer ranks."""
    return F.get(F.split(lineage, ";"), rank - 1)


def clean_rank(
    rank: Column, prefix: str, suffixes: Iterable[str] = presets.STRIPPED_SUFFIXES
) -> Column:
    """Drop one trailing ``_X`` split marker, then the rank prefix."""
    bare = F.regexp_replace(rank, f"_({'|'.join(suffixes)})$", "")
    return F.regexp_replace(bare, f"^{prefix}", "")


def first_piece(text: Column, separator: str) -> Column:
    """Text before the first ``separator``; the whole text if there is none."""
    return F.substring_index(text, separator, 1)


def not_matching(text: Column, pattern: str) -> Column:
    """True unless ``text`` matches; a missing text does not match, so it is kept."""
    return ~F.coalesce(text.rlike(pattern), F.lit(False))


def not_in(value: Column, excluded: Iterable[str]) -> Column:
    """True unless ``value`` is listed; a missing value is not listed, so it is kept."""
    names = list(excluded)
    return ~F.coalesce(value.isin(names), F.lit(False)) if names else F.lit(True)


def recode(value: Column, mapping: Mapping[str, str] | None) -> Column:
    """Replace the listed values and leave all others, nulls included."""
    if not mapping:
        return value
    chain = None
    for old, new in mapping.items():
        hit = value == F.lit(old)
        chain = F.when(hit, F.lit(new)) if chain is None else chain.when(hit, F.lit(new))
    return chain.otherwise(value)


def percent_label(percent: Column) -> Column:
    """``17.7%``: two decimals at most, trailing zeros dropped."""
    text = F.round(percent, 2).cast("string")
    return F.concat(F.regexp_replace(text, r"\.0$", ""), F.lit("%"))
