"""Every registered query against its SQL, on the given tables, and its plan."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest
from compare import open_tables, rows_of_spark, rows_of_sql

import __spark_entry__ as contract
from cladefreq.plans.catalog import all_queries
from cladefreq.plans.oracle import all_oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def db():
    return open_tables(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    columns, found = rows_of_spark(QUERIES[name](spark, SF_DIR))
    expected_columns, expected = rows_of_sql(db, ORACLES[name])
    assert columns == expected_columns
    assert len(found) == len(expected) > 0
    assert found == expected


def test_components(spark):
    scree = QUERIES["pca_variance"](spark, SF_DIR).orderBy("component").collect()
    total = sum(
        r["covariance"]
        for r in QUERIES["feature_covariance"](spark, SF_DIR)
        .where("feature_a = feature_b")
        .collect()
    )
    assert sum(r["std_dev"] ** 2 for r in scree) == pytest.approx(total, rel=1e-9)
    assert scree[-1]["cumulative_share"] == pytest.approx(1)
    assert len(QUERIES["pca_variable_map"](spark, SF_DIR).collect()) == len(scree)


def test_entry(spark):
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
    assert contract.entry(spark).columns == ["feature", "pct"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON = {"pca_variance", "pca_variable_map"}
LAZY = sorted(set(QUERIES) - PYTHON)
#: Wide tables collect the names of their columns, ranks and published tables are stored, lookups are counted.
WITHOUT_JOBS = ["entity_clean", "entity_export", "evidence_detections", "evidence_subset_regex", "array_detections", "lookup_key_check"]


@pytest.mark.parametrize("name", WITHOUT_JOBS)
def test_nothing_runs_at_build_time(spark, name):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    QUERIES[name](spark, SF_DIR)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_product_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|MapInPandas", text)


def test_thresholds_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(QUERIES["evidence_detections"](spark, SF_DIR))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "l_tax" in line)
    for pushed in ("LessThan(l_tax,0.03)", "LessThan(l_discount,0.04)"):
        assert pushed in scan
    assert "l_extendedprice" not in scan and "l_suppkey" not in scan


def test_first_row_is_picked_before_the_shuffle(spark):
    text = plan(QUERIES["entity_export"](spark, SF_DIR))
    lines = [i for i, t in enumerate(text.splitlines()) if "WindowGroupLimit" in t]
    exchange = next(i for i, t in enumerate(text.splitlines()) if "Exchange hashpartitioning" in t)
    assert lines[0] < exchange < lines[1]


def test_grid_reads_its_sources_once(spark):
    df = QUERIES["feature_prevalence_by_group"](spark, SF_DIR)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().executedPlan().toString()
    assert "ReusedExchange" in final
