"""The star tables as text files of other programs: CRLF, ragged lines, header lines, ``NA``, and several files a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.plans import star_views as views
from cladefreq.sources import shared_folder, write_lines

ENTITY_HEADER = ("accession_genbank", "classification", "source_name", "segment", "home", "area")
EVIDENCE_HEADER = (
    "AccessionID", "system.number", "system", "protein.name", "full.seq.E.value", "domain.iE.value",
    "target.coverage", "hmm.coverage",
)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}"


def entity_file(spark: SparkSession, sf_dir: str) -> str:
    """Copies of an id follow it, sometimes in a later file; missing lineages are ``NA``, blank names are blank."""
    raw = views.raw_entities(spark, sf_dir)
    cells = raw.withColumn("home", F.when(F.col("home") != "CHINA", F.col("home")).otherwise(F.lit("")))
    path = _folder(spark, "entities.txt")
    columns = ["entity_id", "lineage", "source_name", "segment", "home", "area"]
    write_lines(cells, ["copy_no", "entity_id"], path, columns=columns, header=ENTITY_HEADER, files=3)
    return path


def array_file(spark: SparkSession, sf_dir: str) -> str:
    """15 cells below 16 names, header lines in between."""
    raw = views.raw_arrays(spark, sf_dir).withColumn("_line", F.monotonically_increasing_id())
    path = _folder(spark, "arrays.tab")
    cells = presets.ARRAY_COLUMNS[:-1]
    write_lines(raw, ["_line"], path, columns=cells, header=presets.ARRAY_COLUMNS, files=2)
    return path


def evidence_file(spark: SparkSession, sf_dir: str) -> str:
    """Comma-separated, in the order of the scores, with quoted names that have commas and quotes in them."""
    raw = views.raw_evidence(spark, sf_dir)
    odd = F.concat(F.col("protein_name"), F.lit(', "x"'))
    name = F.when(F.col("l_partkey") % 7 == 0, odd).otherwise(F.col("protein_name"))
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    e_value = F.when(F.col("l_suppkey") % 11 != 0, F.col("full_seq_e_value"))
    cells = raw.withColumns({"protein_name": quoted, "full_seq_e_value": e_value})
    columns = [
        "entity_id", "locus_number", "feature_type", "protein_name", "full_seq_e_value", "domain_ie_value",
        "target_coverage", "hmm_coverage",
    ]
    path = _folder(spark, "evidence.csv")
    write_lines(cells, views.EVIDENCE_ORDER, path, sep=",", columns=columns, header=EVIDENCE_HEADER, files=4)
    return path


def lookup_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Feature lookup and class lookup."""
    features, classes = _folder(spark, "features.txt"), _folder(spark, "classes.txt")
    write_lines(
        views.feature_lookup(spark, sf_dir), ["feature_type"], features,
        columns=["feature_type", "feature"], header=["system_type", "bact_defence_system"],
    )
    write_lines(
        views.class_lookup(spark), ["row_no"], classes, files=1,
        columns=["prediction", "merged_type", "type_group", "type_class"],
        header=["Prediction", "Subtype", "crispr_type", "crispr_class"],
    )
    return features, classes


def filled_cells(table: DataFrame, name: str) -> DataFrame:
    """Per column of a text table its position, name and number of cells that are not missing."""
    columns = table.columns
    counts = table.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_filled")) for i, c in enumerate(columns)]
    return counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*rows)))
