"""Delimited-text readers.

All cells are read as text under a declared or header schema and cast
afterwards, so no inference pass runs over the files and a stray header line
cannot fail a cast. ``NA`` is missing, a blank text cell is the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladefreq import presets

ORDER_COLUMNS = ("_file", "_block", "_line")

EVIDENCE_NAMES = {
    "accessionid": "entity_id",
    "system": "feature_type",
    "system_number": "locus_number",
}
EVIDENCE_NUMBERS = ("full_seq_e_value", "domain_ie_value", "target_coverage", "hmm_coverage")


def snake_name(name: str) -> str:
    """``full.seq.E.value`` -> ``full_seq_e_value``; no dots, no case."""
    return re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()


def _text(column: str, na: str = "NA"):
    value = F.col(f"`{column}`")
    return F.when(value == na, F.lit(None)).otherwise(F.coalesce(value, F.lit("")))


def _reader(spark: SparkSession, sep: str):
    # Quotes within quotes are doubled, as spreadsheets and R write them.
    options = {"sep": sep, "header": True, "mode": "PERMISSIVE", "escape": '"'}
    return spark.read.options(**options)


def header_names(spark: SparkSession, path: str | Sequence[str], *, sep: str = "\t") -> list[str]:
    """Column names in the first line of a delimited text file; reads no further."""
    return _reader(spark, sep).csv([path] if isinstance(path, str) else list(path)).columns


def read_text_table(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    sep: str = "\t",
    columns: Sequence[str] | None = None,
    file_order: bool = False,
    na: str | None = None,
) -> DataFrame:
    """Delimited text with a header line, every column as text; ``na`` is the text of a missing cell.

    ``columns`` replaces the header names by position; lines with fewer cells
    are padded with missing values. ``file_order`` adds columns whose order is
    the order of lines in the files, however the files are split over tasks:
    file, offset of the split, position within the split.
    """
    reader = _reader(spark, sep)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    paths = [path] if isinstance(path, str) else list(path)
    df = reader.csv(paths)
    order = []
    if file_order:
        order = [
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_line"),
        ]
    plain = (lambda c: F.col(f"`{c}`")) if na is None else (lambda c: _text(c, na).alias(c))
    return df.select(*[plain(c) for c in df.columns], *order)


def read_entities(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Entity table with ``entity_id``, ``lineage``, the other columns and file order."""
    raw = read_text_table(spark, path, file_order=True)
    names = {"accession_genbank": "entity_id", "classification": "lineage"}
    return raw.select(
        *[
            F.col(c) if c in ORDER_COLUMNS else _text(c).alias(names.get(c, c))
            for c in raw.columns
        ]
    )


def read_evidence(
    spark: SparkSession, path: str | Sequence[str], *, sep: str = ","
) -> DataFrame:
    """Evidence table with plain column names, numbers cast, and file order."""
    raw = read_text_table(spark, path, sep=sep, file_order=True)
    out = []
    for c in raw.columns:
        name = EVIDENCE_NAMES.get(snake_name(c), snake_name(c))
        if c in ORDER_COLUMNS:
            out.append(F.col(c))
        elif name in EVIDENCE_NUMBERS:
            out.append(F.expr(f"try_cast(`{c}` AS double)").alias(name))
        else:
            out.append(_text(c).alias(name))
    return raw.select(*out)


def read_arrays(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Merged array file as it is: 16 names over 15 cells, header lines repeated."""
    raw = read_text_table(spark, path, columns=presets.ARRAY_COLUMNS)
    return raw.select(*[_text(c).alias(c) for c in raw.columns])


def read_class_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Lookup type -> merged type, type group and class, with file order."""
    names = ("prediction", "merged_type", "type_group", "type_class")
    raw = read_text_table(spark, path, columns=names, file_order=True)
    return raw.select(*[_text(c).alias(c) for c in names], *ORDER_COLUMNS)


def read_feature_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Lookup type -> feature."""
    names = ("feature_type", "feature")
    raw = read_text_table(spark, path, columns=names)
    return raw.select(*[_text(c).alias(c) for c in names])
