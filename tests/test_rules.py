"""Rules that are easy to get wrong, each on a tiny table."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.functions import clean_rank, first_piece, lineage_rank, not_in, not_matching, percent_label, recode
from cladefreq.operators import detections, entities, grid, lookups, overall
from cladefreq.operators.joins import first_per_key


def one_column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def evaluate(spark, values, expression):
    return [r[0] for r in one_column(spark, values).orderBy("i").select(expression).collect()]


def test_only_listed_suffixes_and_one_prefix_are_stripped(spark):
    values = ["p__X_A", "p__X_B", "p__X_F", "p__X_C", "p__X_A_B", "p__", "X_A", None, "p__A_Ab"]
    found = evaluate(spark, values, clean_rank(F.col("v"), "p__"))
    assert found == ["X", "X", "X", "X_C", "X_A", "", "X", None, "A_Ab"]


def test_short_lineage_gives_no_rank(spark):
    found = evaluate(spark, ["a;b;c", "a", None, ""], lineage_rank(F.col("v"), 2))
    assert found == ["b", None, None, None]


def test_version_is_optional(spark):
    found = evaluate(spark, ["G_1.2", "G_1", "G.1.2", None], first_piece(F.col("v"), "."))
    assert found == ["G_1", "G_1", "G", None]


def test_missing_text_matches_nothing(spark):
    assert evaluate(spark, ["d__Archaea;x", "b", None], not_matching(F.col("v"), "d__Archaea")) == [
        False,
        True,
        True,
    ]
    assert evaluate(spark, ["DMS", "b", None], not_in(F.col("v"), ["DMS"])) == [False, True, True]
    assert evaluate(spark, ["DMS", None], not_in(F.col("v"), [])) == [True, True]


def test_recode_leaves_the_rest(spark):
    found = evaluate(spark, ["a", "b", None], recode(F.col("v"), {"a": "z", "q": "r"}))
    assert found == ["z", "b", None]
    assert evaluate(spark, ["a"], recode(F.col("v"), None)) == ["a"]


def test_percent_label_drops_zeros(spark):
    found = evaluate(spark, ["17.6972281", "50", "82.3", "0"], percent_label(F.col("v").cast("double")))
    assert found == ["17.7%", "50%", "82.3%", "0%"]


def test_first_row_wins_even_if_it_is_then_dropped(spark):
    data = [
        (1, "a", "#N/A"),
        (2, "a", "d__Bacteria;p__P"),
        (3, "b", "d__Bacteria;p__P"),
        (4, "b", "d__Bacteria;p__Q"),
        (5, "c", None),
    ]
    raw = spark.createDataFrame(data, "line int, entity_id string, lineage string")
    assert rows(entities.clean_entities(raw, ["line"]), "entity_id", "group", "subgroup") == [
        ("b", "P", None)
    ]


def test_missing_and_blank_groups_are_groups(spark):
    data = [("a", None), ("b", None), ("c", ""), ("d", "x y")]
    table = spark.createDataFrame(data, "entity_id string, group string")
    assert rows(entities.with_group_sizes(table, ["group"]), "entity_id", "group_size") == [
        ("a", 2),
        ("b", 2),
        ("c", 1),
        ("d", 1),
    ]


def test_thresholds_are_strict_and_joint(spark):
    base = {"full_seq_e_value": 0.0, "domain_ie_value": 0.0, "target_coverage": 0.9, "hmm_coverage": 0.9}
    cases = [
        {},
        {"full_seq_e_value": 0.01},
        {"domain_ie_value": 0.01},
        {"target_coverage": 0.8},
        {"hmm_coverage": 0.8},
        {"hmm_coverage": None},
    ]
    data = [(i, *(base | c).values()) for i, c in enumerate(cases)]
    raw = spark.createDataFrame(data, "i int, " + ", ".join(f"{c} double" for c in base))
    assert rows(detections.evidence_rows(raw), "i") == [(0,)]


def test_probability_text_is_compared_as_a_number(spark):
    lines = [("a c", "k", "x", "0.75"), ("b c", "k", "x", "0.751"), ("c c", "k", "x", "1"), ("d c", "k", "x", "n/a"),
             ("e c", "k", "x", None), ("AccessionID", "k", "x", "Subtype"), (None, "k", "x", "0.9")]
    filler = [c for c in presets.ARRAY_COLUMNS if c not in ("AccessionID", "Contig", "Trusted", "Prediction", "Subtype")]
    raw = spark.createDataFrame(
        lines, "AccessionID string, Contig string, Prediction string, Subtype string"
    ).withColumns({c: F.lit("x") for c in (*filler, "Trusted")})
    found = detections.array_detections(raw.select(*presets.ARRAY_COLUMNS))
    assert rows(found, "entity_id", "probability") == [("b", 0.751), ("c", 1.0), (None, 0.9)]


def grid_input(spark):
    table = spark.createDataFrame(
        [("a", "G"), ("b", "G"), ("c", "H"), ("d", "I"), ("e", None)], "entity_id string, group string"
    )
    found = spark.createDataFrame(
        [
            ("a", "G", "t1", 5, "RM"),
            ("a", "G", "t2", 1, "RM"),
            ("b", "G", "t3", 1, None),
            ("c", "H", "t4", 1, "DMS"),
            ("d", "I", None, None, None),
            ("e", None, "t1", 1, "RM"),
        ],
        "entity_id string, group string, feature_type string, frequency long, feature string",
    )
    return table, found


def test_grid_is_dense_over_what_is_seen(spark):
    table, found = grid_input(spark)
    result = grid.feature_prevalence_by_group(found, table, exclude=["DMS"])
    # H is seen only through an excluded feature, I has no detection; the type
    # without a feature is a feature of its own.
    assert rows(result, "group", "feature", "max_per_entity", "n_with", "n_total", "share") == [
        ("G", "RM", 2, 1, 2, 0.5),
        ("G", None, 1, 1, 1, 0.5),
        ("H", "RM", 0, 0, 0, 0.0),
        ("H", None, 0, 0, 0, 0.0),
        (None, "RM", 1, 1, 1, 1.0),
        (None, None, 0, 0, 0, 0.0),
    ]


def test_recoding_happens_after_the_grid(spark):
    table, found = grid_input(spark)
    result = grid.feature_prevalence_by_group(found, table, exclude=[], recoding={"DMS": "RM"})
    assert result.where("group = 'G' AND feature = 'RM'").count() == 2


def test_grid_of_nothing_is_empty(spark):
    table, found = grid_input(spark)
    assert grid.feature_prevalence_by_group(found.where("frequency > 9"), table).count() == 0


def test_denominator_counts_undetected_entities(spark):
    table = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "entity_id string")
    present = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "entity_id string, feature string")
    assert rows(overall.overall_prevalence(present, table)) == [("x", 50.0), ("y", 25.0)]
    assert [r["feature"] for r in overall.overall_prevalence(present, table).collect()] == ["x", "y"]


def test_first_class_of_a_merged_type(spark):
    classes = spark.createDataFrame(
        [(2, "I-F_T", "I-F", "late", "c"), (1, "I-F", "I-F", "early", "c"), (3, "V", "V", "x", "c")],
        "line int, prediction string, merged_type string, type_group string, type_class string",
    )
    found = grid.first_class_per_merged_type(classes, ["line"])
    assert rows(found, "merged_type", "prediction", "type_group") == [
        ("I-F", "I-F", "early"),
        ("V", "V", "x"),
    ]


def test_unmatched_types(spark):
    lookup = spark.createDataFrame([("t1", "RM"), ("t2", "DMS")], "feature_type string, feature string")
    found = spark.createDataFrame([("a", "t1"), ("a", "t9"), ("a", "t2")], "entity_id string, feature_type string")
    assert rows(detections.feature_pairs([found], lookup)) == [("a", "RM")]


def test_keys(spark):
    table = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert rows(lookups.duplicate_keys(table, "k")) == [("b", 2)]
    assert rows(lookups.key_report(table, "k", "t")) == [("t", 4, 3, 1)]
    with pytest.raises(ValueError, match="b"):
        lookups.require_unique(table, "k")
    good = table.distinct()
    assert lookups.require_unique(good, "k") is good


def test_first_per_key_keeps_the_whole_row(spark):
    data = [("k", 2, "late", 9.0), ("k", 1, "early", None), ("l", 1, None, 1.0)]
    table = spark.createDataFrame(data, "k string, n int, text string, x double")
    assert rows(first_per_key(table, ["k"], ["n"])) == [("k", 1, "early", None), ("l", 1, None, 1.0)]
