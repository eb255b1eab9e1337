"""Covariance and components against plain linear algebra on a small matrix."""

from __future__ import annotations

import numpy as np
import pytest

from cladefreq.operators import components

NAMES = ["a", "a.b `c`", "group", "full"]


@pytest.fixture(scope="module")
def data():
    generator = np.random.default_rng(5)
    values = (generator.random((60, 3)) < [0.3, 0.5, 0.7]).astype(int)
    values[:, 2] |= values[:, 0]
    return np.hstack([values, np.ones((60, 1), dtype=int)])


@pytest.fixture(scope="module")
def sets(spark, data):
    """Sorted features per entity, and one entity without any."""
    rows = [(f"e{i}", sorted(n for n, x in zip(NAMES, r) if x)) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "entity_id string, features array<string>")


@pytest.fixture(scope="module")
def covariance(sets):
    return components.feature_covariance(sets)


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_covariance(covariance, data):
    found = {(r["feature_a"], r["feature_b"]): r["covariance"] for r in covariance.collect()}
    expected = np.cov(data, rowvar=False)
    assert len(found) == 16
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES):
            assert found[a, b] == pytest.approx(expected[i, j], abs=1e-14)


def test_nothing_runs_before_it_is_asked_for(spark, sets):
    before = jobs(spark)
    found = components.feature_covariance(sets)
    components.variance_table(found)
    components.variable_map(found)
    assert jobs(spark) == before


def test_pairs_never_together_are_filled_in(spark):
    rows = [("e1", ["x"]), ("e2", ["y"]), ("e3", []), ("e4", ["x", "z"])]
    sets = spark.createDataFrame(rows, "entity_id string, features array<string>")
    counted = {(r[0], r[1]): r[2] for r in components.pair_counts(sets).collect()}
    assert counted == {("x", "x"): 2, ("y", "y"): 1, ("z", "z"): 1, ("x", "z"): 1}
    found = {(r[0], r[1]): r[2] for r in components.feature_covariance(sets).collect()}
    assert len(found) == 9
    assert found["x", "y"] == found["y", "x"] == pytest.approx((0 - 2 * 1 / 4) / 3)
    assert found["x", "x"] == pytest.approx((2 - 4 / 4) / 3)


def test_counts_beyond_doubles_stay_exact(spark):
    """n * n_ab - n_a * n_b of counts whose products no double holds."""
    n = 3_000_000_019
    top = spark.sql(
        f"SELECT CAST(CAST({n} AS DECIMAL(19,0)) * CAST({n - 1} AS DECIMAL(19,0))"
        f" - CAST({n - 1} AS DECIMAL(19,0)) * CAST({n} AS DECIMAL(19,0)) + 1 AS DOUBLE)"
    )
    assert top.first()[0] == 1.0


def test_variance_table(covariance, data):
    singular = np.linalg.svd(data - data.mean(axis=0), compute_uv=False)
    table = components.variance_table(covariance).orderBy("component").collect()
    assert [r["component"] for r in table] == [1, 2, 3, 4]
    assert [r["std_dev"] for r in table] == pytest.approx(list(singular / np.sqrt(59)), abs=1e-7)
    assert [r["eigenvalue"] for r in table] == pytest.approx(list(singular**2 / 60), abs=1e-12)
    assert [r["share"] for r in table] == pytest.approx(list(singular**2 / (singular**2).sum()), abs=1e-12)
    assert table[-1]["cumulative_share"] == pytest.approx(1)


def test_variable_map(covariance, data):
    centred = data - data.mean(axis=0)
    _, singular, axes = np.linalg.svd(centred, full_matrices=False)
    coords = (axes.T * singular / np.sqrt(60))[:, :2]
    coords *= np.sign(coords[np.abs(coords).argmax(axis=0), [0, 1]])
    cos2 = (coords[:3] ** 2).sum(axis=1) / data[:, :3].var(axis=0)
    table = {r["feature"]: r for r in components.variable_map(covariance).collect()}
    for i, name in enumerate(NAMES[:3]):
        assert table[name]["coord1"] == pytest.approx(coords[i, 0], abs=1e-9)
        assert table[name]["coord2"] == pytest.approx(coords[i, 1], abs=1e-9)
        assert table[name]["cos2"] == pytest.approx(cos2[i], abs=1e-9)
        assert table[name]["kept"] == (cos2[i] >= 0.02)
    assert table["full"]["cos2"] is None and not table["full"]["kept"]


def test_cut_on_cos2(covariance):
    assert components.variable_map(covariance, min_cos2=2.0).where("kept").count() == 0


def test_largest_loading_is_positive_and_the_first_among_equals():
    values = np.array([[1.0, -1.0], [-1.0, 1.0]])
    eigenvalues, loadings = components.decompose(["a", "b"], values)
    assert eigenvalues.tolist() == pytest.approx([2, 0])
    assert loadings[0, 0] > 0 > loadings[1, 0] and loadings[0, 1] > 0


def test_no_entities_and_no_features(spark):
    for rows in ([], [("e1", []), ("e2", [])]):
        sets = spark.createDataFrame(rows, "entity_id string, features array<string>")
        found = components.feature_covariance(sets)
        assert found.count() == 0
        assert components.variance_table(found).count() == 0
        assert components.variable_map(found).count() == 0


def test_one_entity_has_no_covariance(spark):
    sets = spark.createDataFrame([("e1", ["x"])], "entity_id string, features array<string>")
    found = components.feature_covariance(sets)
    assert [r["covariance"] for r in found.collect()] == [None]
    assert components.variance_table(found).count() == 1
