"""Column expressions shared by the operators; all built-in, none in Python."""

from cladefreq.functions.columns import (
    clean_rank,
    first_piece,
    lineage_rank,
    not_in,
    not_matching,
    percent_label,
    recode,
)

__all__ = [
    "clean_rank",
    "first_piece",
    "lineage_rank",
    "not_in",
    "not_matching",
    "percent_label",
    "recode",
]
