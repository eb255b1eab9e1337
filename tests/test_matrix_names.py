"""Matrix columns come from the data, whatever the features are called; grids and ranks in many buckets and ranges."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cladefreq.operators import entities, grid, matrix, overall
from cladefreq.operators.ranks import numbered

ODD = ["a.b", "a`b", "a b", "group", "Group", "subgroup", "entity_id", "row_total", "é;=,", "`", "9"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(f"e{i}", f"l{i}", "g", "s") for i in range(12)], "entity_id string, lineage string, group string, subgroup string")


@pytest.fixture(scope="module")
def pairs(spark):
    data = [(f"e{i}", f) for i in range(11) for f in ODD[i:]] * 2
    return spark.createDataFrame(data, "entity_id string, feature string").repartition(5)


def test_every_feature_has_a_column_of_its_own(pairs, table, tmp_path, spark):
    wide = matrix.presence_matrix(pairs, entities.with_group_sizes(table))
    wide.write.parquet(str(tmp_path / "wide"))
    read = spark.read.parquet(str(tmp_path / "wide"))
    keys = ["entity_id", *matrix.GROUP_COLUMNS]
    assert len({c.lower() for c in read.columns}) == len(read.columns) == len(keys) + len(ODD)
    names = matrix.feature_dictionary(pairs, keys)
    assert names["a.b"] == "a.b" and names["group"] == "group_3" and names["Group"] == "Group_2"
    found = {r["entity_id"]: r for r in read.collect()}
    for i in range(12):
        for k, feature in enumerate(ODD):
            assert found[f"e{i}"][names[feature]] == int(k >= i and i < 11)


def test_totals_of_every_feature(pairs, table):
    sized = entities.with_group_sizes(table, ["subgroup"])
    found = matrix.matrix_with_totals(pairs, sized)
    names = matrix.feature_dictionary(pairs, ["entity_id", "subgroup", "row_total"])
    total = found.where("subgroup = 'fam_sum'").collect()
    assert len(total) == 1 and total[0]["entity_id"] is None
    for k, feature in enumerate(ODD):
        assert total[0][names[feature]] == k + 1
    assert total[0]["row_total"] == sum(range(1, len(ODD) + 1))
    assert found.count() == 13
    assert found.where("entity_id = 'e11'").first()["row_total"] == 0


def test_totals_of_nothing(spark, table):
    none = spark.createDataFrame([], "entity_id string, feature string")
    sized = entities.with_group_sizes(table.where("false"), ["subgroup"])
    assert [tuple(r) for r in matrix.matrix_with_totals(none, sized).collect()] == [(None, "fam_sum", 0)]


def test_totals_come_from_one_scan(pairs, table):
    sized = entities.with_group_sizes(table, ["subgroup"]).persist()
    plan = matrix.matrix_with_totals(pairs.persist(), sized)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" in plan
    assert plan.count("InMemoryRelation [entity_id#") <= 2


def test_a_new_feature_needs_no_list(spark, pairs, table):
    more = pairs.union(spark.createDataFrame([("e3", "ninth")], "entity_id string, feature string"))
    wide = matrix.presence_matrix(more, entities.with_group_sizes(table))
    assert rows(wide.where("ninth = 1"), "entity_id") == [("e3",)]


def test_more_features_than_a_wide_table_holds(spark):
    """12,000 features: the sparse form and its long form have no limit."""
    sets = spark.range(40).select(
        F.col("id").cast("string").alias("entity_id"),
        F.lit("s").alias("subgroup"),
        F.transform(F.sequence(F.lit(0), F.lit(11_999)), lambda i: F.format_string("f%05d", i)).alias("features"),
    )
    long = matrix.pruned_presence(sets, 5)
    counts = long.groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("present").alias("p")).collect()
    assert len(counts) == 40 and {(r["n"], r["p"]) for r in counts} == {(12_000, 12_000)}


@pytest.mark.parametrize(("buckets", "places"), [(64, 32), (1, 1), (3, 2)])
def test_grid_in_buckets(spark, buckets, places):
    draw = random.Random(3)
    groups = [None, "", *[f"g{i}" for i in range(9)]]
    features = [None, *[f"f{i}" for i in range(14)]]
    cells = {(draw.choice(groups), draw.choice(features)): draw.randint(1, 9) for _ in range(50)}
    frame = spark.createDataFrame([(g, f, n) for (g, f), n in cells.items()], "group string, feature string, n long")
    found = grid.dense_grid(frame, "group", "feature", ["n"], buckets=buckets, places=places)
    seen = [{g for g, _ in cells}, {f for _, f in cells}]
    expected = Counter((g, f, cells.get((g, f), 0)) for g in seen[0] for f in seen[1])
    assert Counter(tuple(r) for r in found.select("group", "feature", "n").collect()) == expected


def test_no_array_holds_all_features(spark):
    """The feature list of a bucket stays short, and so does what a group folds."""
    cells = spark.range(3000).select(
        (F.col("id") % 3).cast("string").alias("group"), F.col("id").cast("string").alias("feature"), F.lit(1).cast("long").alias("n")
    )
    found = grid.dense_grid(cells, "group", "feature", ["n"], buckets=30)
    assert found.count() == 9000 and found.where("n = 1").count() == 3000
    lists = cells.groupBy(F.pmod(F.xxhash64(F.struct("feature")), F.lit(30))).agg(F.collect_list("feature").alias("l"))
    assert lists.agg(F.max(F.size("l"))).first()[0] < 200


def test_numbers_follow_the_order(spark):
    draw = random.Random(9)
    data = [(draw.choice(["a", "b", None]), draw.randint(0, 5)) for _ in range(500)]
    frame = spark.createDataFrame(data, "kind string, value int").repartition(7)
    for within in (None, "kind"):
        found = numbered(frame, [F.col("value")], within).collect()
        by = {}
        for r in found:
            by.setdefault(r["kind"] if within else 0, []).append((r["pos"], r["value"], r["n"]))
        for own in by.values():
            own.sort()
            assert [p for p, _, _ in own] == list(range(len(own)))
            assert [v for _, v, _ in own] == sorted(v for _, v, _ in own)
            assert {n for _, _, n in own} == {len(own)}


def test_equal_rows_are_numbered_in_many_ranges(spark):
    same = spark.range(20_000).select(F.lit(1).alias("value"))
    found = numbered(same, [F.col("value")])
    assert found.agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (0, 19_999, 20_000)
    plan = found._jdf.queryExecution().toString()
    assert "Window [" not in plan or "_run" in plan


def test_many_groups_of_one_size(spark):
    """Equal sizes are ranked by name without a window over them."""
    cells = spark.range(2000).select(
        F.format_string("g%04d", F.col("id")).alias("group"), F.lit(7).cast("long").alias("group_size"),
        F.lit("f").alias("feature"), F.lit(1).cast("long").alias("n_with"), F.lit(0.1).alias("share"),
    )
    shown = grid.heatmap_display(cells)
    assert shown.where("display_rank <> CAST(substring(group, 2) AS INT) + 1").count() == 0
    assert shown.count() == 2000
    assert not [x for x in shown._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x and "group" in x]


def test_sentinel_is_no_feature_overall(spark, table):
    presence = spark.createDataFrame([("e1", "#N/A"), ("e2", "RM"), ("e3", "raw")], "entity_id string, feature string")
    found = overall.overall_prevalence(presence, table, {"raw": "RM"})
    assert [(r["feature"], round(r["pct"], 3)) for r in found.collect()] == [("RM", 8.333), ("RM", 8.333)]
