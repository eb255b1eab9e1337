"""The three reports from text files to result tables."""

from __future__ import annotations

import pytest
from conftest import rows

from cladefreq import presets
from cladefreq.plans.reports import feature_report, supplementary_report, type_report
from cladefreq.sources import (
    publish,
    read_arrays,
    read_class_lookup,
    read_entities,
    read_evidence,
    read_feature_lookup,
)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Seven entities of one large family, one of another, and odd ones out."""
    folder = tmp_path_factory.mktemp("inputs")
    head = "\t".join(presets.ENTITY_EXPORT_COLUMNS)
    line = "{0}\tdb\tsea\t\tno\tNA\td__{1};p__{2};c__;o__;f__{3};g__;s__"
    entities = [
        *[line.format(f"G_{i}", "Bacteria", "Alpha_A" if i % 2 else "Alpha", "F1") for i in range(7)],
        line.format("G_7", "Bacteria", "Beta", "F2"),
        line.format("G_8", "Archaea", "Beta", "F2"),
        line.format("G_0", "Bacteria", "Late", "Copy"),
        "G_9\tdb\tsea\t\tno\tNA\t#N/A",
    ]
    (folder / "entities.txt").write_text("\n".join([head, *entities]) + "\n")

    head = "AccessionID,system.number,system,protein.name,full.seq.E.value,domain.iE.value,target.coverage,hmm.coverage,gtdb"
    evidence = [
        *[f"G_{i},1,RM_I,MTase,1e-9,1e-9,0.9,0.9,x" for i in range(7)],
        *[f"G_{i},2,RM_II,MTase,1e-9,1e-9,0.9,0.9,x" for i in range(3)],
        "G_1,3,pAgo_sys,pAgo_II_A,1e-9,1e-9,0.9,0.9,x",
        "G_1,3,pAgo_sys,pAgo,1e-9,1e-9,0.9,0.9,x",
        "G_2,4,retron_I,RT_G2,1e-9,1e-9,0.9,0.9,x",
        "G_2,4,retron_I,other,1e-9,1e-9,0.9,0.9,x",
        "G_9,5,retron_I,RT_G2,1e-9,1e-9,0.9,0.9,x",
        "G_3,6,retron_I,RT_G2,0.5,1e-9,0.9,0.9,x",
        "G_4,7,DMS_x,y,1e-9,1e-9,0.9,0.9,x",
    ]
    (folder / "evidence.csv").write_text("\n".join([head, *evidence]) + "\n")

    head = "\t".join(presets.ARRAY_COLUMNS)
    middle = "\t".join(["1"] * 9)
    array = "{0} c\t{0}_1\t" + middle + "\tTrue\t{1}\t{1}\t{2}"
    arrays = [
        *[array.format(f"G_{i}.1", "I-F", 0.9) for i in range(6)],
        head,
        array.format("G_0", "I-F_T", 0.99),
        array.format("G_7.2", "I-E", 0.8),
        array.format("G_6", "I-E", 0.75),
    ]
    (folder / "arrays.tab").write_text("\n".join([head, *arrays]) + "\n")

    classes = ["p\ts\tt\tc", *[f"{p}\t{m}\tType I\tClass 1" for p, m in (("I-E", "I-E"), ("I-F", "I-F"), ("I-F_T", "I-F"))]]
    (folder / "classes.txt").write_text("\r\n".join(classes) + "\r\n")
    features = ["a\tb", "RM_I\tRM", "RM_II\tRM", "pAgo_sys\tArgonaute", "retron_I\tRetron", "DMS_x\tDMS"]
    features += [f"{t}\tCRISPR-Cas_cctyper" for t in ("I-E", "I-F", "I-F_T")]
    (folder / "features.txt").write_text("\r\n".join(features) + "\r\n")
    return {
        "entities": read_entities(spark, str(folder / "entities.txt")),
        "evidence": read_evidence(spark, str(folder / "evidence.csv")),
        "arrays": read_arrays(spark, str(folder / "arrays.tab")),
        "classes": read_class_lookup(spark, str(folder / "classes.txt")),
        "features": read_feature_lookup(spark, str(folder / "features.txt")),
    }


def test_type_report(inputs):
    report = type_report(inputs["entities"], inputs["arrays"], inputs["classes"])
    assert report["typed_detections"].count() == 8
    assert rows(report["type_prevalence_by_group"], "group", "merged_type", "n_with", "n_total", "share") == [
        ("Alpha", "I-E", 0, 0, 0.0),
        ("Alpha", "I-F", 6, 7, 6 / 7),
        ("Beta", "I-E", 1, 1, 1.0),
        ("Beta", "I-F", 0, 0, 0.0),
    ]
    assert rows(report["type_distribution"]) == [("I-E", "Class 1", 1), ("I-F", "Class 1", 7)]
    assert rows(report["type_heatmap"], "display_rank", "axis_label") == [
        (1, "Beta\n1"),
        (1, "Beta\n1"),
        (2, "Alpha\n7"),
        (2, "Alpha\n7"),
    ]


def test_feature_report(spark, inputs, tmp_path):
    report = feature_report(
        inputs["entities"], inputs["evidence"], inputs["arrays"], inputs["features"], str(tmp_path / "out")
    )
    assert rows(report["feature_prevalence_overall"]) == [
        ("Argonaute", 12.5),
        ("CRISPR-Cas", 87.5),
        ("RM", 87.5),
        ("Retron", 12.5),
    ]
    assert rows(report["feature_bars"], "bar_rank", "feature") == [
        (1, "CRISPR-Cas"),
        (2, "RM"),
        (3, "Argonaute"),
        (4, "Retron"),
    ]
    grid = report["feature_prevalence_by_group"]
    assert grid.count() == 8 and "DMS" not in {r["feature"] for r in grid.collect()}
    assert rows(grid.where("feature = 'RM'"), "group", "max_per_entity", "n_with", "n_total") == [
        ("Alpha", 2, 7, 10),
        ("Beta", 0, 0, 0),
    ]
    assert {r["subgroup"] for r in report["feature_prevalence_by_subgroup"].collect()} == {"F1", "F2"}
    assert {r["subgroup"] for r in report["subgroup_heatmap"].collect()} == {"F1"}
    assert rows(report["share_vs_rest"], "slice", "label") == [("CRISPR-Cas", "87.5%"), ("Other", "12.5%")]
    regions = {r["region"]: r["n_entities"] for r in report["set_overlap_regions"].collect() if r["n_entities"]}
    assert regions == {
        "CRISPR-Cas": 1,
        "RM": 1,
        "RM & CRISPR-Cas": 4,
        "RM & CRISPR-Cas & other_system": 2,
    }
    assert report["set_membership"].where("set_name = 'other_system'").count() == 2
    paths = publish({k: v for k, v in report.items() if k != "detections_enriched"}, str(tmp_path / "out"))
    for name, path in paths.items():
        assert spark.read.parquet(path).count() == report[name].count()


def test_supplementary_report(inputs):
    report = supplementary_report(
        inputs["entities"], inputs["evidence"], inputs["arrays"], inputs["features"]
    )
    listing = report["table_entities"]
    assert listing.count() == 8
    assert rows(listing.where("entity_id = 'G_7'"), "database", "host_species", "oxygen_requirement") == [
        ("db", "", None)
    ]
    assert rows(report["table_argonaute"], "entity_id", "protein_name") == [("G_1", "pAgo_II_A")]
    assert "gtdb" not in report["table_argonaute"].columns
    retron = report["table_retron"]
    assert rows(retron.selectExpr("entity_id", "lineage IS NOT NULL")) == [("G_2", True), ("G_9", False)]
    wide = report["presence_matrix"]
    assert wide.count() == 8
    assert rows(wide.where("entity_id IN ('G_6', 'G_7')"), "entity_id", "RM", "CRISPR-Cas", "Retron") == [
        ("G_6", 1, 0, 0),
        ("G_7", 0, 1, 0),
    ]
    total = report["presence_matrix_totals"].where("entity_id IS NULL").first()
    assert (total["RM"], total["CRISPR-Cas"], total["row_total"]) == (7, 6, 15)
    # Only features of more than five entities of the large family remain.
    assert report["presence_matrix_pruned"].columns == ["entity_id", "subgroup", "CRISPR-Cas", "RM"]
    assert [r["share"] for r in report["pca_variance"].collect()] == pytest.approx([1.0, 0.0], abs=1e-12)
    kept = {r["feature"]: r["kept"] for r in report["pca_variable_map"].collect()}
    assert kept == {"CRISPR-Cas": True, "RM": False}
    assert report["feature_covariance"].count() == 4
