"""Vector and page operators against plain versions, over given rows with nulls, ties and zero vectors."""

import math

import numpy as np
from pyspark.sql import functions as F

from cladefreq.llm import embedding_dedup, extraction, topk_search

NAN, INF = float("nan"), float("inf")
ODD = [(900, None, "a"), (901, [0.0] * 8, "a"), (902, [NAN] + [1.0] * 7, "a"), (903, [INF] + [1.0] * 7, "a"), (904, [None] + [1.0] * 7, "a")]


def vectors(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(12, 8))
    rows = []
    for i in range(240):
        v = centres[i % 12] + draw.normal(size=8) * (0.25 if i % 3 else 0.6)
        rows.append((i, [float(x) for x in v], [None, "a", "b"][i % 5 % 3]))
    rows += [(300 + i, rows[1][1], "b") for i in range(30)] + ODD
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_near_vectors_match_all_pairs(spark):
    rows, frame = vectors(spark)
    links = {k: set() for k, _, _ in rows}
    for i, (a, v, x) in enumerate(rows):
        for b, w, y in rows[:i]:
            if x is not None and x == y and finite(v) and finite(w) and any(v) and any(w):
                if np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                    links[a].add(b)
                    links[b].add(a)
    root = {k: k for k in links}
    changed = True
    while changed:
        changed = False
        for a, others in links.items():
            low = min([root[a], *(root[b] for b in others)])
            changed |= low != root[a]
            root[a] = low
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(frame, threshold=0.93).collect()}
    assert got == {k: (len(v), root[k], root[k] == k) for k, v in links.items()}


def test_top_products_match_all_pairs(spark):
    rows, frame = vectors(spark)
    own = {k: np.floor(256 * np.array(v)).astype(int) for k, v, _ in rows if finite(v)}
    wanted = set()
    for q in (k for k in own if k % 50 == 0):
        best = sorted((-int(own[q] @ v), k) for k, v in own.items() if k != q)[:5]
        wanted |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(best)}
    found = topk_search.top_k(frame, F.col("vec_id") % 50 == 0, k=5, scale=256.0)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()} == wanted


def test_repeated_ids_are_rows_of_their_own(spark):
    """The better of two rows with one id counts, and each is found by the other."""
    rows = [(1, [2.0, 2.0], "a"), (1, [5.0, 5.0], "a"), (50, [1.0, 1.0], "a"), (50, [2.0, 0.0], "a"), (7, [1.0, 0.0], "a"), (8, [1.0], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(frame, F.col("vec_id") % 50 == 0, k=3, scale=1.0).collect())
    assert got == sorted([(50, 1, 1, 10), (50, 2, 1, 4), (50, 3, 50, 2), (50, 1, 1, 10), (50, 2, 1, 4), (50, 3, 7, 2)])


def test_searches_of_nothing(spark):
    frame = spark.createDataFrame([(1, [2.0, 2.0], "a"), (2, None, None)], "vec_id long, embedding array<double>, label string")
    assert topk_search.top_k(frame, F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.top_k(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert embedding_dedup.near_vectors(frame.where("false")).count() == 0
    assert sorted(map(tuple, embedding_dedup.near_vectors(frame).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_hub_of_links(spark):
    """Copies near one vector form a component of one root, however many they are."""
    draw = np.random.default_rng(1)
    hub = draw.normal(size=16)
    rows = [(i, [float(x) for x in hub + draw.normal(size=16) * 0.15], "a") for i in range(1200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.93
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(frame).collect()}
    assert all(abs(got[i][0] - (near[i].sum() - 1)) == 0 for i in range(1200))
    assert {c for n, c in got.values() if n} == {min(i for i in range(1200) if got[i][0])}


def test_article_without_menus_and_scripts(spark):
    article = "<p>The river runs past &eacute; old stone houses, where people sell bread  and fish every morning of the week.</p>" * 3
    html = f"<html><head><style>x</style></head><body><nav><a href='/'>Home</a></nav><article>{article}</article><footer>Imprint</footer><script>var a;</script></body></html>"
    frame = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.extract(frame).collect()}
    line = "The river runs past é old stone houses, where people sell bread and fish every morning of the week."
    assert got == {1: ("\n".join([line] * 3), 3 * len(line) + 2), 2: ("", 0), 3: ("", 0)}
