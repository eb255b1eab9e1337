"""Registered queries of this package: against their SQL, their plans, and plain judgements of urls, languages and copies."""

import os
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from compare import open_tables, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

import __spark_entry__ as contract
from cladefreq.llm import bagminhash, common, language_id, near_dedup, url_filters
from cladefreq.llm.common import connected
from cladefreq.llm.queries import llm_oracles, llm_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


def test_all_are_registered():
    names = [*llm_queries(), "pipeline"]
    assert set(names) <= set(contract.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))
    assert set(llm_oracles()) <= set(contract.oracle_sql())


@tables
@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_sql(spark, name):
    columns, found = rows_of_spark(llm_queries()[name](spark, SF_DIR))
    expected_columns, expected = rows_of_sql(open_tables(SF_DIR), llm_oracles()[name])
    assert columns == expected_columns and found == expected and found


@tables
def test_url_filters_are_native_and_without_products(spark):
    plan = llm_queries()["op1_url_filters"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoop|Python|MapInArrow|MapInPandas", plan)


def test_unseen_hosts_follow_their_domain_then_suffix(spark):
    pages = [(i, f"http://h{i % 5}.bad.xyz/p") for i in range(60)] + [(100 + i, f"http://h{i % 5}.good.xyz/p") for i in range(60)]
    pages += [(200 + i, f"http://s{i}.junk") for i in range(60)]
    unseen = [(900, "http://new.bad.xyz/"), (901, "http://new.good.xyz/"), (902, "http://other.junk/"), (903, None), (904, "no url"), (905, "http://EXAMPLE.org/es/x")]
    labels = [(i, 0) for i in range(60)] + [(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)] + [(100, None), (100, 1), (None, 0)]
    frame = spark.createDataFrame(pages + unseen, "page_id long, url string")
    known = spark.createDataFrame(labels, "page_id long, good long")
    found = {r.page_id: r for r in url_filters.judge_urls(frame, known, ["org/"], ["example.org/es/"]).collect()}
    assert {k: found[k].verdict for k in (900, 901, 902, 905)} == {900: "block", 901: "allow", 902: "block", 905: "block"}
    assert (found[903].host, found[903].path, found[904].host) == ("", "", "")
    assert found[905].host == "example.org" and found[905].rule == "example.org/es/"
    assert all(0 <= r.posterior <= r.upper <= 1 for r in found.values())
    assert found[0].verdict == "block" and found[100].verdict == "allow"


def test_urls_without_labels_or_pages(spark):
    frame = spark.createDataFrame([(1, "http://a.b/"), (1, "http://a.b/")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good long")
    assert [r.verdict for r in url_filters.judge_urls(frame, none, [], []).collect()] == ["allow", "allow"]
    assert url_filters.judge_urls(frame.where("false"), none, [], []).count() == 0


@tables
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", F.col("lang").alias("own"))
    found = llm_queries()["op6_language_id"](spark, SF_DIR).where("held_out")
    right = found.join(docs, "doc_id").select((F.col("lang_pred") == F.col("own")).cast("int").alias("r"), "score")
    share, low, high = right.agg(F.avg("r"), F.min("score"), F.max("score")).first()
    assert share > 0.98 and 0 <= low <= high <= 1


def test_character_models_sum_to_one():
    """After any context the probabilities of all characters and of an unknown one add up to one."""
    texts = {"en": ["the cat sat on the mat and the dog ran to the cat " * 4] * 6, "de": ["der hund und die katze gehen heim zum haus " * 4] * 6}
    model = language_id.fit(texts)
    assert model is not None and model.langs == ["de", "en"]
    first = np.exp(model.logs[0].astype(np.float64)).sum(0)
    assert (first <= 1 + 1e-4).all() and (first > 0.9).all()


def truth(docs):
    """Classes of documents by all pairs of shingle multisets."""
    own = {k: Counter() for k, _ in docs}
    for k, t in docs:
        words = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        own[k] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
    root = {k: k for k, _ in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = set()
    for i, (a, t) in enumerate(docs):
        for b, u in docs[:i]:
            total = sum((own[a] | own[b]).values())
            if t and (t == u or total and sum((own[a] & own[b]).values()) / total >= 0.8):
                links.add((a, b))
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in root}, links


@pytest.mark.parametrize("tile", [256, 2])
def test_classes_of_a_large_group_of_near_copies(spark, monkeypatch, tile):
    """A base, copies of it that are near to it and less so to each other, chains of copies, and unlike texts."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    draw = np.random.default_rng(5)
    base = [f"w{x}" for x in draw.integers(0, 900, 150)]

    def changed(words, n):
        out = list(words)
        for k in draw.choice(len(out), n, replace=False):
            out[k] = f"n{draw.integers(0, 9000)}"
        return out

    docs = [(i, " ".join(changed(base, int(draw.integers(0, 5))))) for i in range(70)]
    chain = [f"c{x}" for x in range(120)]
    for i in range(25):
        chain = changed(chain, 2)
        docs.append((200 + i, " ".join(chain)))
    docs += [(300 + i, " ".join(f"u{x}" for x in draw.integers(0, 5000, 80))) for i in range(20)]
    wanted, links = truth(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()}
    joined = sum(got[a] == got[b] for a, b in links)
    assert joined / len(links) >= 0.99
    assert all(wanted[a] == wanted[b] for a in got for b in [got[a]])


def test_names_and_repeats_of_near_copies(spark):
    rows = [(1, "same words here", "a", 1), (1, "same words here", "a", 1), (2, "same words here", "b", 2), (None, "same words here", "c", 3), (3, None, "d", 4), (3, "", "e", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _rn string, _digest int")
    left = sorted(map(tuple, near_dedup.drop_near_duplicates(frame).collect()), key=str)
    assert left == sorted([rows[0], rows[4], rows[5]], key=str)
    assert near_dedup.drop_near_duplicates(frame).columns == frame.columns
    assert near_dedup.drop_near_duplicates(frame.where("false")).count() == 0
    assert near_dedup.near_duplicates(frame.where("false")).count() == 0


def test_components_around_a_star(spark):
    links = spark.range(1, 3000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    more = spark.createDataFrame([(5000, 5001), (5001, 5002), (7000, 7000), (None, 1)], "a long, b long")
    found = {r.id: r.root for r in connected(links.union(more)).collect()}
    assert found == {k: 0 for k in range(3000)} | {5000: 5000, 5001: 5000, 5002: 5000}


@pytest.mark.parametrize("task_rows", [1_000_000, 2900, 1])
def test_rounds_of_components_are_short_plans(spark, monkeypatch, task_rows):
    """The driver holds a round's plan for each of its stages: windows alone, unless an id has too many links for a task."""
    draw = np.random.default_rng(5)
    pairs = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(4000, 4200)]
    pairs += [tuple(map(int, x)) for x in draw.integers(10_000, 13_000, (1500, 2))]
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    wanted = {}
    for k in sorted(k for k in near if set(near[k]) != {k}):
        reach = [] if k in wanted else [k]
        while reach:
            if (x := reach.pop()) not in wanted:
                wanted[x] = k
                reach += near[x]
    plans, stored = [], common.stored

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(common, "stored", kept)
    monkeypatch.setattr(common, "TASK_ROWS", task_rows, raising=False)
    links = spark.createDataFrame([*pairs, (7, None), (9000, 9000)], "a long, b long")
    assert {r.id: r.root for r in connected(links).collect()} == wanted
    assert len(plans) > 3 and ("Join" in "".join(plans)) == (task_rows < 3000)
    assert max(len(p.splitlines()) for p in plans) < (30 if task_rows > 3000 else 150)


def test_bands_find_what_overlaps():
    """Recall of the bands at an overlap of about 0.8, over random pairs."""
    draw = np.random.default_rng(8)
    left, right = [], []
    for _ in range(300):
        words = [f"w{x}" for x in draw.integers(0, 10**6, 200)]
        other = list(words)
        for k in draw.choice(200, 4, replace=False):
            other[k] = f"n{draw.integers(0, 10**6)}"
        left.append(" ".join(words))
        right.append(" ".join(other))
    near = bagminhash.overlap(left, right)
    of, hashes, counts = bagminhash.shingles([*left, *right])
    registers = bagminhash.signatures(of, hashes, counts, 600, near_dedup.REGISTERS)
    marks = bagminhash.bands(registers, near_dedup.ROWS)
    found = (marks[:300] == marks[300:]).any(1)
    agree = (registers[:300] == registers[300:]).mean(1)
    floor = 0.8 - near_dedup.SLACK * (0.16 / near_dedup.REGISTERS) ** 0.5
    linked = near >= 0.8
    assert linked.sum() > 100 and (found & (agree >= floor))[linked].mean() >= 0.99
