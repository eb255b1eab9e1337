"""A small invented data set with results worked out by hand."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cladefreq import presets
from cladefreq.operators import detections, entities, grid, matrix, overall, sets

EXCLUDE = ("DMS",)
RECODING = presets.FEATURE_RECODE


def lineage(domain, group, family):
    return f"d__{domain};{group};c__;o__;{family};g__;s__"


@pytest.fixture(scope="module")
def raw_entities(spark):
    data = [
        ("e1", lineage("Bacteria", "p__Alpha_A", "f__F1")),
        ("e2", lineage("Bacteria", "p__Alpha_B", "f__F1")),
        ("e3", lineage("Bacteria", "p__Alpha_C", "f__F2")),
        ("e4", lineage("Archaea", "p__Gamma", "f__F3")),
        ("e5", "#N/A"),
        ("e6", lineage("Bacteria", "p__Beta", "f__F2_F")),
        ("e1", lineage("Bacteria", "p__Beta", "f__F9")),
    ]
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(data)], "line int, entity_id string, lineage string"
    )


@pytest.fixture(scope="module")
def cleaned(raw_entities):
    return entities.clean_entities(raw_entities, ["line"])


@pytest.fixture(scope="module")
def raw_evidence(spark):
    good = (1e-9, 1e-9, 0.95, 0.95)
    edge = (0.01, 1e-9, 0.95, 0.95)
    data = [
        ("e1", "t1", 1, *good),
        ("e1", "t1", 1, *good),
        ("e1", "t1", 2, *good),
        ("e1", "t2", 3, *good),
        ("e2", "t1", 4, *good),
        ("e2", "t9", 5, *edge),
        ("e4", "t1", 6, *good),
        ("e3", "t4", 7, *good),
    ]
    return spark.createDataFrame(
        data,
        "entity_id string, feature_type string, locus_number int, full_seq_e_value double,"
        " domain_ie_value double, target_coverage double, hmm_coverage double",
    )


def array_line(cell, kind, probability):
    middle = ["x"] * 9
    return (cell, "array", *middle, "True", kind, kind, probability, None)


@pytest.fixture(scope="module")
def raw_arrays(spark):
    data = [
        array_line("e1.1 c1", "I-F", "0.9"),
        array_line("e1.1 c2", "I-F_T", "0.8"),
        tuple(presets.ARRAY_COLUMNS),
        array_line("e2 c1", "I-F", "0.75"),
        array_line("e3.2 c1", "I-F", "0.76"),
    ]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in presets.ARRAY_COLUMNS))


@pytest.fixture(scope="module")
def features(spark):
    data = [
        ("t1", "RM"),
        ("t2", "RM"),
        ("t4", "DMS"),
        ("I-F", "CRISPR-Cas_cctyper"),
        ("I-F_T", "CRISPR-Cas_cctyper"),
    ]
    return spark.createDataFrame(data, "feature_type string, feature string")


@pytest.fixture(scope="module")
def classes(spark):
    data = [(0, "I-F", "I-F", "Type I", "Class 1"), (1, "I-F_T", "I-F", "Type I", "Class 1")]
    return spark.createDataFrame(
        data, "line int, prediction string, merged_type string, type_group string, type_class string"
    )


@pytest.fixture(scope="module")
def sources(raw_evidence, raw_arrays):
    return detections.evidence_rows(raw_evidence), detections.array_detections(raw_arrays)


@pytest.fixture(scope="module")
def enriched(sources, cleaned, features):
    evidence, arrays = sources
    counts = detections.count_types(detections.evidence_detections(evidence), arrays)
    return detections.detections_enriched(counts, cleaned, features)


@pytest.fixture(scope="module")
def pairs(sources, features):
    return detections.feature_pairs(sources, features, exclude=EXCLUDE, recoding=RECODING)


def test_entities_and_sizes(cleaned):
    sized = entities.with_group_sizes(cleaned)
    assert rows(sized, "entity_id", "group", "group_size", "subgroup", "subgroup_size") == [
        ("e1", "Alpha", 2, "F1", 2),
        ("e2", "Alpha", 2, "F1", 2),
        ("e3", "Alpha_C", 1, "F2", 2),
        ("e6", "Beta", 1, "F2", 2),
    ]


def test_array_repair(sources):
    assert rows(sources[1], "entity_id", "contig", "array_id", "feature_type", "probability") == [
        ("e1", "c1", "array", "I-F", 0.9),
        ("e1", "c2", "array", "I-F_T", 0.8),
        ("e3", "c1", "array", "I-F", 0.76),
    ]


def test_evidence_pairs_per_locus(sources):
    assert rows(detections.evidence_detections(sources[0])) == [
        ("e1", "t1"),
        ("e1", "t1"),
        ("e1", "t2"),
        ("e2", "t1"),
        ("e3", "t4"),
        ("e4", "t1"),
    ]


def test_enriched(enriched):
    assert rows(enriched, "entity_id", "feature_type", "frequency", "feature") == [
        ("e1", "I-F", 1, "CRISPR-Cas_cctyper"),
        ("e1", "I-F_T", 1, "CRISPR-Cas_cctyper"),
        ("e1", "t1", 2, "RM"),
        ("e1", "t2", 1, "RM"),
        ("e2", "t1", 1, "RM"),
        ("e3", "I-F", 1, "CRISPR-Cas_cctyper"),
        ("e3", "t4", 1, "DMS"),
        ("e6", None, None, None),
    ]


def test_typed(sources, cleaned, classes):
    sized = entities.with_group_sizes(cleaned, ["group"])
    typed = detections.typed_detections(sources[1], sized, classes)
    assert rows(typed) == [
        ("Alpha", 2, "e1", "I-F", "I-F", "Type I", "Class 1"),
        ("Alpha", 2, "e1", "I-F_T", "I-F", "Type I", "Class 1"),
        ("Alpha_C", 1, "e3", "I-F", "I-F", "Type I", "Class 1"),
    ]


def test_type_grid(sources, cleaned, classes):
    result = grid.type_prevalence_by_group(sources[1], cleaned, classes, ["line"])
    assert rows(result, "group", "merged_type", "n_with", "n_total", "share", "prediction") == [
        ("Alpha", "I-F", 1, 2, 0.5, "I-F"),
        ("Alpha_C", "I-F", 1, 1, 1.0, "I-F"),
    ]
    totals = grid.type_totals(result)
    assert rows(grid.type_distribution(totals)) == [("I-F", "Class 1", 3)]


def test_feature_grid(enriched, cleaned):
    result = grid.feature_prevalence_by_group(
        enriched, cleaned, exclude=EXCLUDE, recoding=RECODING
    )
    assert rows(result, "group", "feature", "max_per_entity", "n_with", "n_total", "share") == [
        ("Alpha", "CRISPR-Cas", 2, 1, 2, 0.5),
        ("Alpha", "RM", 2, 2, 3, 1.0),
        ("Alpha_C", "CRISPR-Cas", 1, 1, 1, 1.0),
        ("Alpha_C", "RM", 0, 0, 0, 0.0),
    ]


def test_overall(pairs, cleaned):
    result = overall.overall_prevalence(detections.feature_presence(pairs, cleaned), cleaned)
    assert rows(result) == [("CRISPR-Cas", 50.0), ("RM", 50.0)]
    assert rows(overall.share_vs_rest(result, "CRISPR-Cas")) == [
        ("CRISPR-Cas", 50.0, "50%"),
        ("Other", 50.0, "50%"),
    ]
    assert rows(overall.share_vs_rest(result, "absent"), "slice", "pct") == [
        ("Other", 100.0),
        ("absent", 0.0),
    ]
    assert rows(overall.bar_display(result), "feature", "bar_rank") == [("CRISPR-Cas", 1), ("RM", 2)]


def test_sets(pairs, cleaned):
    chosen = {"RM": ("RM",), "CRISPR-Cas": ("CRISPR-Cas",)}
    presence = detections.feature_presence(pairs, cleaned)
    assert rows(sets.set_membership(presence, chosen)) == [
        ("CRISPR-Cas", "e1"),
        ("CRISPR-Cas", "e3"),
        ("RM", "e1"),
        ("RM", "e2"),
    ]
    regions = rows(sets.set_overlap_regions(presence, chosen))
    assert [r[:3] for r in regions] == [
        ("CRISPR-Cas", 1, 1),
        ("RM", 1, 1),
        ("RM & CRISPR-Cas", 2, 1),
    ]
    assert [r[3] for r in regions] == pytest.approx([100 / 3] * 3)


def test_empty_regions_are_shown(pairs, cleaned):
    presence = detections.feature_presence(pairs, cleaned)
    chosen = {"RM": ("RM",), "none": ("nothing",)}
    assert rows(sets.set_overlap_regions(presence, chosen), "region", "n_entities") == [
        ("RM", 2),
        ("RM & none", 0),
        ("none", 0),
    ]


def test_matrix(pairs, cleaned):
    sized = entities.with_group_sizes(cleaned)
    wide = matrix.presence_matrix(pairs, sized)
    assert rows(wide, "entity_id", "RM", "CRISPR-Cas") == [
        ("e1", 1, 1),
        ("e2", 1, 0),
        ("e3", 0, 1),
        ("e6", 0, 0),
    ]
    totals = matrix.matrix_with_totals(pairs, sized, min_group_size=1)
    assert rows(totals, "entity_id", "subgroup", "CRISPR-Cas", "RM", "row_total") == [
        ("e1", "F1", 1, 1, 2),
        ("e2", "F1", 0, 1, 1),
        ("e3", "F2", 1, 0, 1),
        ("e6", "F2", 0, 0, 0),
        (None, "fam_sum", 2, 2, 4),
    ]


def test_pruning(pairs, cleaned):
    sized = entities.with_group_sizes(cleaned)
    # Subgroups of more than one entity; e6 has no feature and is dropped.
    present = matrix.size_cut_sets(pairs, sized, 1)
    assert rows(matrix.pruned_presence(present, 1), "entity_id", "feature", "present") == [
        ("e1", "CRISPR-Cas", 1),
        ("e1", "RM", 1),
        ("e2", "CRISPR-Cas", 0),
        ("e2", "RM", 1),
        ("e3", "CRISPR-Cas", 1),
        ("e3", "RM", 0),
    ]
    # A cut equal to the total drops the column (strict), and every column may go.
    assert matrix.pruned_matrix(present, 2).columns == ["entity_id", "subgroup"]
    assert matrix.pruned_presence(present, 2).count() == 0
    # The size cut is strict as well.
    assert matrix.size_cut_sets(pairs, sized, 2).count() == 0


def test_row_of_zeros_survives_the_column_cut(spark):
    present = spark.createDataFrame(
        [("a", "s", ["x"]), ("b", "s", ["x"]), ("c", "s", ["y"])],
        "entity_id string, subgroup string, features array<string>",
    )
    wide = matrix.pruned_matrix(present, 1)
    assert wide.columns == ["entity_id", "subgroup", "x"]
    assert rows(wide, "entity_id", "x") == [("a", 1), ("b", 1), ("c", 0)]


def test_heatmap_display(spark):
    cells = [("B", 7, 101), ("A", 7, 100), ("C", 6, 0), ("D", 5, 1), (None, 9, 2)]
    data = spark.createDataFrame(
        [(g, s, "f", n, 0.5) for g, s, n in cells],
        "group string, group_size long, feature string, n_with long, share double",
    )
    shown = grid.heatmap_display(data)
    assert rows(shown, "display_rank", "group", "axis_label", "text_angle") == [
        (1, "C", "C\n6", 0),
        (2, "A", "A\n7", 0),
        (3, "B", "B\n7", 90),
        (4, None, "NA\n9", 0),
    ]
    assert grid.heatmap_display(data, min_group_size=None).count() == 5


def test_subset(spark, cleaned):
    data = [
        (3, "e1", "t1", 1, "pAgo_LongA"),
        (2, "e1", "t1", 1, "pAgo_II"),
        (1, "e1", "t1", 1, "pAgo"),
        (4, "e4", "t1", 1, "xpAgo_I"),
        (5, "e2", "t2", 1, "pAgo_S"),
    ]
    evidence = spark.createDataFrame(
        data, "line int, entity_id string, feature_type string, locus_number int, protein_name string"
    )
    condition = detections.named_or_matching(
        "protein_name", presets.ARGONAUTE_PATTERN, presets.ARGONAUTE_NAME
    )
    found = detections.evidence_subset(evidence, cleaned, condition, ["line"])
    assert rows(found.select("entity_id", "protein_name", F.col("lineage").isNotNull())) == [
        ("e1", "pAgo", True),
        ("e4", "xpAgo_I", False),
    ]
