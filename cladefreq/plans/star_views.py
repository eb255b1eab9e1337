"""The star tables seen as entities, detections and lookups.

Customers are the entities (region and nation make their lineage), line items
are detections with evidence scores, events are detections in the ragged array
layout. Odd cases are planted by key so that each rule has rows to act on:
unclassified and missing lineages, short lineages, blank and marked ranks, later
copies of an id, repeated header lines, types missing from a lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladefreq import presets

ENTITY_ORDER = ("copy_no",)
EVIDENCE_ORDER = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
)
LOOKUP_ORDER = ("row_no",)
ENTITY_COLUMNS = ("source_name", "segment", "home", "area", "balance")

# Cuts that suit the value ranges of the star tables.
EVIDENCE_CUTS = {
    "max_full_e": 0.03,
    "max_domain_e": 0.04,
    "min_target_coverage": 0.5,
    "min_hmm_coverage": 0.1,
}
PROTEIN_PATTERN, PROTEIN_NAME = "PROMO_Brand#(1|2)", "PROMO"
TYPE_PREFIX, PROTEIN_PREFIX = "^red", "^S"
UNMATCHED_TYPE, RARE_TYPE = "old rod", "prototype"
EXCLUDED = ("gizmo", "rod")
RECODING = {"signal_raw": "signal"}
SHARE_FEATURE = "signal"
SETS = {
    "gear": ("gear",),
    "ring": ("ring",),
    "signal": ("signal",),
    "other": ("anvil", "bolt", "plate", "widget"),
}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
CLASSES = (
    ("signup", "signup", "Type A", "Class 1", 1),
    ("view", "view", "Type B", "Class 2", 2),
    ("click", "view", "Type C", "Class 2", 3),
    ("purchase", "purchase", "Type A", "Class 1", 4),
)

# Columns in use. Declared, so that no job opens the files to infer them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double",
    "events": "event_id bigint, user_id bigint, event_type string, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows, columns: Sequence[str]) -> DataFrame:
    """A short fixed table that never leaves the JVM."""
    values = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


PART_TYPE = f"IF(p_partkey % 1000 = 17, '{RARE_TYPE}', p_name)"


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    split_mark = """CASE WHEN c_custkey % 50 = 7 THEN '_C' WHEN c_custkey % 4 = 0 THEN '_A'
        WHEN c_custkey % 4 = 1 THEN '_B' WHEN c_custkey % 4 = 2 THEN '_F' ELSE '' END"""
    family = """CASE WHEN c_custkey % 83 = 7 THEN '' WHEN c_custkey % 50 = 9 THEN concat(n_name, '_C')
        WHEN c_custkey % 3 = 0 THEN concat(n_name, '_A') ELSE n_name END"""
    full = f"""concat('d__', IF(c_mktsegment = 'MACHINERY', 'Archaea', 'Bacteria'), ';p__', r_name,
        {split_mark}, ';c__x;o__x;f__', {family}, ';g__x;s__', c_name)"""
    lineage = f"""CASE WHEN copy_no = 1 THEN 'd__Bacteria;p__COPY;c__x;o__x;f__COPY;g__x;s__x'
        WHEN c_acctbal < 0 THEN '{presets.SENTINEL}'
        WHEN c_custkey % 97 = 11 THEN NULL
        WHEN c_custkey % 89 = 5 THEN concat('d__Bacteria;p__', r_name)
        ELSE {full} END"""
    placed = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    copies = placed.selectExpr(
        "*", "explode(IF(c_custkey % 10 = 3, array(0, 1), array(0))) AS copy_no"
    )
    return copies.selectExpr(
        "concat('C', c_custkey) AS entity_id",
        f"{lineage} AS lineage",
        "c_name AS source_name",
        "c_mktsegment AS segment",
        "n_name AS home",
        "r_name AS area",
        "c_acctbal AS balance",
        "copy_no",
    )


def raw_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    )
    return items.selectExpr(
        "concat('C', o_custkey) AS entity_id",
        f"{PART_TYPE} AS feature_type",
        "l_linenumber AS locus_number",
        "l_tax AS full_seq_e_value",
        "l_discount AS domain_ie_value",
        "l_quantity / 50 AS target_coverage",
        "p_size / 50 AS hmm_coverage",
        "IF(p_size % 5 = 0, p_type, concat(p_type, '_', p_brand)) AS protein_name",
        *EVIDENCE_ORDER,
    )


def raw_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the ragged text table: id and contig in one cell, the last cell empty.

    Every 2500th line has a header line next to it, as in concatenated files.
    """
    number = "CAST(regexp_extract(props, '([0-9]+)', 1) AS int)"
    cells = {
        "AccessionID": "concat('C', user_id, IF(event_id % 2 = 1, '.1', ''), ' ev', event_id)",
        "Contig": "concat('ev', event_id, '_1')",
        "CRISPR": "CAST(event_id AS string)",
        "Start": f"CAST(event_id + {number} AS string)",
        "Trusted": "event_type",
        "Prediction": "event_type",
        "Subtype": f"CAST({number} / 100 AS string)",
        "Subtype_probability": "CAST(NULL AS string)",
    }
    lines = table(spark, sf_dir, "events").selectExpr(
        "*", "explode(IF(event_id % 2500 = 0, array(true, false), array(false))) AS is_header"
    )
    return lines.selectExpr(
        *[f"IF(is_header, '{c}', {cells.get(c, repr('0'))}) AS {c}" for c in presets.ARRAY_COLUMNS]
    )


def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").selectExpr(f"{PART_TYPE} AS feature_type").distinct()
    events = literal_rows(
        spark, [(t, "signal_raw") for t in EVENT_TYPES], ("feature_type", "feature")
    )
    return (
        types.where(f"feature_type <> '{UNMATCHED_TYPE}'")
        .selectExpr(
            "feature_type",
            f"IF(feature_type = '{RARE_TYPE}', '{RARE_TYPE}',"
            " substring_index(feature_type, ' ', -1)) AS feature",
        )
        .unionByName(events)
    )


def class_lookup(spark: SparkSession) -> DataFrame:
    return literal_rows(
        spark, CLASSES, ("prediction", "merged_type", "type_group", "type_class", "row_no")
    )
