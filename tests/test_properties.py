"""Random tables: results against a brute-force count, and relations among them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from cladefreq.operators import detections, entities, grid, matrix, overall, sets
from cladefreq.plans.reports import enriched_presence

SETS = {"s0": ("f0",), "s1": ("f1", "f2"), "s2": ("f3",)}


@pytest.fixture(scope="module", params=[1, 2])
def world(request, spark):
    """Entities in groups, one group and one entity holding much of everything."""
    rng = random.Random(request.param)
    groups = ["g0"] * 5 + ["g1", "g2 x", "", None]
    members = {f"e{i}": rng.choice(groups) for i in range(60)}
    types = {f"t{i}": f"f{i % 6}" for i in range(14)}
    types["t13"] = None
    found = [
        ("e0" if rng.random() < 0.3 else f"e{rng.randrange(70)}", f"t{rng.randrange(16)}")
        for _ in range(300)
    ]
    table = spark.createDataFrame(list(members.items()), "entity_id string, group string")
    lookup = spark.createDataFrame(list(types.items()), "feature_type string, feature string")
    detected = spark.createDataFrame(found, "entity_id string, feature_type string")
    enriched = detections.detections_enriched(detections.count_types(detected), table, lookup)
    return members, types, found, table, lookup, detected, enriched


def brute_cells(members, types, found, excluded):
    per_entity = defaultdict(set)
    for entity, kind in found:
        if entity in members:
            per_entity[entity, types.get(kind)].add(kind)
    cells = defaultdict(list)
    for (entity, feature), kinds in per_entity.items():
        cells[members[entity], feature].append(len(kinds))
    sizes = Counter(members.values())
    groups, features = {g for g, _ in cells}, {f for _, f in cells}
    return {
        (g, f): (
            sizes[g],
            max(cells.get((g, f), [0])),
            len(cells.get((g, f), [])),
            sum(cells.get((g, f), [])),
            len(cells.get((g, f), [])) / sizes[g],
        )
        for g in groups
        for f in features
        if f not in excluded
    }


def test_grid_equals_brute_force(world):
    members, types, found, table, _, _, enriched = world
    result = grid.feature_prevalence_by_group(enriched, table, exclude=["f5"])
    got = {(r["group"], r["feature"]): tuple(r)[1:2] + tuple(r)[3:] for r in result.collect()}
    assert got == brute_cells(members, types, found, {"f5"})
    assert all(0 <= v[-1] <= 1 for v in got.values())


def test_groups_add_up_to_the_overall_prevalence(world):
    members, _, _, table, lookup, detected, enriched = world
    cells = grid.feature_prevalence_by_group(enriched, table, exclude=[])
    with_feature = Counter()
    for r in cells.where("feature IS NOT NULL").collect():
        with_feature[r["feature"]] += r["n_with"]
    pairs = detections.feature_pairs([detected], lookup, exclude=[])
    direct = overall.overall_prevalence(detections.feature_presence(pairs, table), table)
    via_enriched = overall.overall_prevalence(enriched_presence(enriched, exclude=[]), table)
    expected = {f: n / len(members) * 100 for f, n in with_feature.items()}
    assert dict(map(tuple, direct.collect())) == pytest.approx(expected)
    assert dict(map(tuple, via_enriched.collect())) == pytest.approx(expected)


def test_regions_add_up_to_the_union(world):
    _, _, _, table, lookup, detected, _ = world
    presence = detections.feature_presence(
        detections.feature_pairs([detected], lookup, exclude=[]), table
    )
    members = sets.set_membership(presence, SETS)
    inside = defaultdict(set)
    for name, entity in members.collect():
        inside[entity].add(name)
    expected = Counter(frozenset(v) for v in inside.values())
    regions = sets.set_overlap_regions(presence, SETS).collect()
    assert len(regions) == 7
    for r in regions:
        names = frozenset(r["region"].split(" & "))
        assert (r["n_entities"], r["n_sets"]) == (expected[names], len(names))
    assert sum(r["n_entities"] for r in regions) == len(inside)
    assert sum(r["pct"] for r in regions) == pytest.approx(100)


def test_matrix_agrees_with_presence(world):
    members, _, _, table, lookup, detected, _ = world
    pairs = detections.feature_pairs([detected], lookup, exclude=["f4"])
    present = {tuple(r) for r in detections.feature_presence(pairs, table).collect()}
    wide = matrix.presence_matrix(pairs, table, columns=["group"]).collect()
    assert {r["entity_id"] for r in wide} == set(members)
    for r in wide:
        for f in ("f0", "f1", "f2", "f3", "f5"):
            assert r[f] == ((r["entity_id"], f) in present)


def test_sizes_add_up(world):
    members, *_, table, _, _, _ = world
    sized = entities.with_group_sizes(table, ["group"]).collect()
    sizes = Counter(members.values())
    assert len(sized) == len(members)
    assert all(r["group_size"] == sizes[r["group"]] for r in sized)
