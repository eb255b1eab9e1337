"""Merkle manifest, importance resampling and the inverted multi-index against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladefreq.llm import importance, merkle, multi_index

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos long, tree string, n int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """Root of a list of digests, and the siblings of each, from the lowest on, with whether they stand left."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            if i ^ 1 < len(nodes):
                path.append((nodes[i ^ 1], i % 2 == 1))
            else:
                path.append(None)
        at = [i // 2 for i in at]
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def folded(leaf, path):
    for step in path:
        leaf = sha(leaf) if step is None else sha(step[0], leaf) if step[1] else sha(leaf, step[0])
    return leaf


def plain_manifest(docs):
    leaves = {}
    for doc_id, text, lang, source, n_chars in docs:
        own = [sha(*map(field, (doc_id, source, lang, n, text))) for n in (n_chars, None if n_chars is None else n_chars + 1)]
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        leaves.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own[0], own[1] if bad else own[0], doc_id))
    order = sorted(leaves, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        leaves[lang].sort()
        trees[lang] = climb([x[2] for x in leaves[lang]])
    root, tops = climb([trees[lang][0] for lang in order])
    out = []
    for lang, top in zip(order, tops, strict=True):
        subroot, paths = trees[lang]
        for (_, _, leaf, claimed, doc_id), path in zip(leaves[lang], paths, strict=True):
            proof = sha("".join(s[0] for s in path + top if s))
            found = folded(claimed, path + top)
            out.append((doc_id, leaf, subroot, root, proof, found, found == root))
    return sorted(out, key=str)


def manifest_of(frame):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars") + F.when(bad, 1).otherwise(0)
    own = [merkle.digest(*(merkle.field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))) for n in (F.col("n_chars"), more)]
    return sorted((tuple(r) for r in merkle.manifest(frame, *own).collect()), key=str)


def some_docs():
    draw = random.Random(4)
    docs = [(i, f"text {draw.random()} é", draw.choice(["en"] * 9 + ["de", "日", None]), "s", draw.randint(0, 9)) for i in range(150)]
    docs += [(7, docs[7][1], "en", "s", docs[7][4]), (8, "other", "en", None, None), (None, None, None, None, None), (None, "", "", "", 0)]
    return docs + [(500 + i, "same", "en", "s", 1) for i in range(3)] + [(600, "x" * 300_000, "alone", "s", 2)]


@pytest.mark.parametrize("bits", [(10, 14), (2, 2), (1, 0)])
def test_manifest_equals_the_plain_one(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(merkle, "CHUNK_BITS", bits[1])
    docs = some_docs()
    frame = spark.createDataFrame([(*d, "x", 1, "y", 2) for d in docs], DOCS).repartition(7)
    assert manifest_of(frame) == plain_manifest(docs)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_manifest_of_few(spark, n):
    docs = [(i, "t", "en", "s", 1) for i in range(n)]
    frame = spark.createDataFrame([(*d, "x", 1, "y", 2) for d in docs], DOCS)
    assert manifest_of(frame) == (plain_manifest(docs) if docs else [])


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, ngram):
    words = WORDS.findall((text or "").encode().lower().decode())
    return len(words), [" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, buckets, ngram):
    hashed = lambda text: [zlib.crc32(f.encode()) % buckets for f in plain_features(text, ngram)[1]]
    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in hashed(text):
            s[b] += 1
    for text in target:
        for b in hashed(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        found = hashed(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, plain_features(text, 1)[0]])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("buckets", "ngram"), [(10_000, 2), (97, 3), (100_000, 1)])
def test_drawn_documents_equal_the_plain_ones(spark, buckets, ngram):
    draw = random.Random(8)
    vocabulary = ["River", "stone", "été", "漢字", "a1", "x" * 200, "İ", "ÀB", "don't", "🙂z"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", "  ", "\n", "-", "\x7f"]) for _ in range(n))
    docs = [(i, text(draw.randint(0, 60))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, " ?! "), (None, text(40)), (5, docs[5][1]), (5, text(30)), (93, text(4000)), (94, "y" * 100_000)]
    target = [text(50) for _ in range(4)] + [None, ""]
    frame = spark.createDataFrame([(k, t, 0, "r") for k, t in docs], "doc_id long, text string, score int, rank string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, wanted, buckets=buckets, ngram=ngram).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_resample(docs, target, buckets, ngram)


def test_drawing_from_and_for_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i, "a b c d e " * 5) for i in range(8)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    got = importance.resample(some, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


def plain_neighbours(rows, k, is_query):
    """Per query row, the ids and products of all others, best first."""
    fine = [(i, key, np.array(v)) for i, (key, v) in enumerate(rows) if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, key, v in fine:
        if is_query(key):
            found = [(-float(sum(a * b for a, b in zip(v, w, strict=True))), other) for j, other, w in fine if j != i and len(w) == len(v)]
            out.append((key, sorted(found)[:k]))
    return out


def test_neighbours_of_clusters_and_odd_rows(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(20, 12)) * 2
    rows = [(i, [float(x) for x in centres[i % 20] + draw.normal(size=12) * 0.3]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(20, [1.0, 2.0]), (2001, [2.0, 1.0]), (2002, [1.0])]
    nan = float("nan")
    rows += [(2010, None), (2011, []), (2012, [0.0] * 12), (2013, [nan] * 12), (2014, [None] * 12), (None, rows[0][1]), (40, rows[41][1])]
    schema = "vec_id long, embedding array<double>, row int, dim string, cell int"
    frame = spark.createDataFrame([(k, v, 1, "d", 2) for k, v in rows], schema).repartition(6)
    got = {}
    for r in multi_index.nearest_neighbours(frame, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    wanted = plain_neighbours(rows, 20, lambda key: key % 20 == 0)
    assert set(got) == {key for key, found in wanted if found}
    hits = total = 0
    for key, best in wanted:
        if sum(1 for k, _ in wanted if k == key) > 1:
            continue
        own = sorted(got.get(key, []))
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert [(s, v) for _, s, v in own] == sorted((s, v) for _, s, v in own)
        hits += len({s for _, s, _ in own} & {s for s, _ in best})
        total += len({s for s, _ in best})
    assert hits / total >= 0.9
    assert len(got[20]) == 20 + 1 and len(got[40]) == 40


def test_pairs_come_in_order_of_their_sums():
    draw = np.random.default_rng(2)
    left, right = draw.normal(size=7), draw.integers(0, 3, 9).astype(float)
    sums = [left[c // 9] + right[c % 9] for c in multi_index.in_order(left, right)]
    assert len(sums) == 63 and sums == sorted(sums)
    assert len(set(multi_index.in_order(left, right))) == 63


def test_neighbours_without_rows_or_queries(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert multi_index.nearest_neighbours(none, F.col("vec_id") % 20 == 0).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert multi_index.nearest_neighbours(some, F.col("vec_id") % 20 == 0).count() == 0
    lone = spark.createDataFrame([(20, [1.0, 0.0])], schema)
    assert multi_index.nearest_neighbours(lone, F.col("vec_id") % 20 == 0).count() == 0
