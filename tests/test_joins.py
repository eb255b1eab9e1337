"""Joins under skew: same rows as a plain join, spread as promised."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladefreq.operators.joins import hot_key_join, is_short, lookup_join


@pytest.fixture(scope="module")
def facts(spark):
    """One key on half of the rows, missing keys, keys without a partner."""
    n = F.col("id")
    key = F.when(n % 2 == 0, "hot").when(n % 11 == 0, None).otherwise(F.concat(F.lit("k"), n % 40))
    return spark.range(4000).select(n.cast("string").alias("row"), key.alias("key"))


@pytest.fixture(scope="module")
def dim(spark):
    keys = ["hot", *[f"k{i}" for i in range(0, 30)]]
    return spark.createDataFrame([(k, f"value of {k}") for k in keys], "key string, value string")


def bag(df):
    return Counter(tuple(r) for r in df.select("row", "key", "value").collect())


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("task_rows", "parts"), [(10, 10**6), (1000, 100), (10, 5), (10**9, 1)])
def test_hot_key_join_equals_a_plain_join(facts, dim, how, task_rows, parts):
    spread = hot_key_join(facts, dim, "key", how=how, spread=["row"], task_rows=task_rows, parts=parts)
    assert bag(spread) == bag(facts.join(dim, "key", how))


def test_hot_rows_meet_in_many_places(spark, facts, dim):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = hot_key_join(facts, dim, "key", how="left", spread=["row"], task_rows=100)
        place = joined.withColumn("p", F.spark_partition_id())
        assert place.where("key = 'hot'").select("p").distinct().count() > 4
        assert place.where("key IS NULL").select("p").distinct().count() > 4
        assert bag(joined) == bag(facts.join(dim, "key", "left"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_other_join_types_are_refused(facts, dim):
    with pytest.raises(ValueError):
        hot_key_join(facts, dim, "key", how="full", spread=["row"])


def test_null_may_match_null(spark, facts, dim):
    with_null = dim.unionByName(spark.createDataFrame([(None, "none")], "key string, value string"))
    left, right = facts.alias("l"), with_null.alias("r")
    plain = left.join(right, F.expr("l.key <=> r.key"), "left").select("row", "l.key", "value")
    for task_rows in (10, 10**9):
        spread = hot_key_join(
            facts, with_null, "key", how="left", spread=["row"], null_matches=True, task_rows=task_rows
        )
        assert bag(spread) == bag(plain)


def test_no_task_holds_a_whole_key_however_many_are_hot(spark):
    """1,500 keys of 200 rows, all of them over the limit of 50: each lies in several tasks, none is left out."""
    keys, rows_of_each = 1500, 200
    facts = spark.range(keys * rows_of_each).select(
        F.col("id").cast("string").alias("row"), (F.col("id") % keys).alias("key")
    )
    dim = spark.range(keys).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.enabled": "false", "shuffle.partitions": "64"}
    for name, value in conf.items():
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        joined = hot_key_join(facts, dim, "key", how="inner", spread=["row"], task_rows=50)
        held = joined.groupBy("key", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
        found = held.groupBy("key").agg(F.max("n").alias("most"), F.sum("n").alias("n")).agg(
            F.count("*"), F.max("most"), F.sum("n"), F.min("n")
        )
        n_keys, most, n, least = found.first()
        assert (n_keys, n, least) == (keys, keys * rows_of_each, rows_of_each)
        assert most < rows_of_each
        assert joined.where("value <> key * 2").isEmpty()
    finally:
        for name in conf:
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_lookup_join_broadcasts_only_short_lookups(facts, dim):
    plain = bag(facts.join(dim, "key", "left"))
    short = lookup_join(facts, dim, "key", spread=["row"])
    assert is_short(dim, 31) and not is_short(dim, 30)
    long = lookup_join(facts, dim, "key", spread=["row"], short=is_short(dim, 30))
    assert bag(short) == bag(long) == plain

    def analyzed(df):
        return df._jdf.queryExecution().analyzed().toString()

    assert "strategy=broadcast" in analyzed(short) and "_salt" not in analyzed(short)
    assert "_salt" in analyzed(long)
