"""Embedding near-dedup: PCA-ordered tiled comparison with suffix-norm bounds.

Equal vectors of a label are one representative with a weight. Representatives are rotated to principal components,
sorted by the cells of the leading ones and cut into tiles. Tiles meet only where the boxes of their leading components
are near enough for the wanted cosine. In a meeting the leading components are multiplied first; the norms of what is
left of both bound the remainder, and a pair goes on only while it can still reach the threshold. What remains is decided
by the cosine of the vectors as given, in double precision. A meeting returns each vector's number of links and its root
in the meeting's own links, never the pairs, so its output is as small as its input.

Vectors that are null, zero or hold null or non-finite components, and rows whose label is null, link with nothing.
Lengths differ: no link. Repeated ids are vectors of their own. An empty table gives no rows. Equal vectors are told by two
64-bit hashes of label and components, which are not compared again. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladefreq.llm.common import connected, stored
from cladefreq.llm.vectors import directions, takes_part, tiles
from cladefreq.operators.joins import hot_key_join, salted_join

TILE = 2_048
#: Leading components whose cells order the vectors, and whose boxes choose the tiles that meet.
ORDERED = 3
BOXED = 8
STEPS = (8, 24)
ROWS_AT_ONCE = 256
SLACK = 1e-9
MET = "id long, links long, root long"


def near_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with cosine of a[i] and b[j] at or above `threshold`."""
    lengths = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    u, v = (a / lengths[0][:, None]) @ rotation, (b / lengths[1][:, None]) @ rotation
    steps = [s for s in STEPS if s < a.shape[1]]
    rest = [[np.linalg.norm(m[:, s:], axis=1) for s in steps] for m in (u, v)]
    found = []
    for start in range(0, len(a), ROWS_AT_ONCE):
        own = slice(start, start + ROWS_AT_ONCE)
        if steps:
            s = steps[0]
            bound = u[own, :s] @ v[:, :s].T + np.outer(rest[0][0][own], rest[1][0])
            i, j = np.nonzero(bound >= threshold - SLACK)
        else:
            i, j = (m.ravel() for m in np.indices((len(u[own]), len(v))))
        i = i + start
        for k in range(1, len(steps)):
            s = steps[k]
            partial = np.einsum("nd,nd->n", u[i, :s], v[j, :s])
            keep = partial + rest[0][k][i] * rest[1][k][j] >= threshold - SLACK
            i, j = i[keep], j[keep]
        keep = np.einsum("nd,nd->n", a[i], b[j]) / (lengths[0][i] * lengths[1][j]) >= threshold
        found.append((i[keep], j[keep]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    doubles = F.transform(vector_col, lambda x: x.cast("double"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    given = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.when(takes_part(vector_col), doubles).alias("v"),
    )
    linkable = F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & (length > 0)
    # Two hashes of label and components name a group of equal vectors.
    group = F.concat_ws(":", F.xxhash64("label", "v"), F.xxhash64("v", "label", F.lit(1)))
    given = given.withColumn("group", F.when(linkable, group))
    groups = given.where("group is not null").groupBy("group").agg(
        F.min("id").alias("id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    # Ids may repeat, so representatives get a number of their own, fixed by storing it.
    numbered = groups.withColumns({"dim": F.size("v"), "rep": F.monotonically_increasing_id()})
    groups = stored(numbered, "near-groups")
    turns = groups.sparkSession.sparkContext.broadcast(directions(groups, centred=True))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def turned(batches):
        for batch in batches:
            keys = []
            for v in batch.column(3).to_pylist():
                x = np.array(v)
                key = (x / np.linalg.norm(x)) @ turns.value[len(v)][:, :BOXED]
                keys.append(np.pad(key, (0, BOXED - len(key))).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.float64()))], [*batch.schema.names, "key"])

    columns = groups.select("label", "dim", F.col("rep").alias("id"), "v", "weight")
    keyed = columns.mapInArrow(turned, T.StructType([*columns.schema.fields, T.StructField("key", T.ArrayType(T.DoubleType()))]))
    cells = [F.floor(F.col("key")[k] / F.lit(reach or 1.0)) for k in range(ORDERED)]
    order = ["label", "dim", *cells, F.col("key")[0], "id"]
    made = stored(tiles(keyed.repartitionByRange(*order).sortWithinPartitions(*order), TILE, BOXED), "near-tiles")
    tile = F.concat_ws("-", "part", "place")
    first = lambda side, by: F.floor(F.col(side)[0] / F.lit(reach or 1.0)) + by
    meta = made.select("label", "dim", tile.alias("tile"), "low", "high")
    a = meta.select("label", "dim", F.col("tile").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"),
                    F.explode(F.sequence(first("low", 0), first("high", 0))).alias("cell"))
    b = meta.select("label", "dim", F.col("tile").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"),
                    F.explode(F.sequence(first("low", -1), first("high", 1))).alias("cell"))
    gap = sum(
        (F.pow(F.greatest(F.col("low_a")[k] - F.col("high_b")[k], F.col("low_b")[k] - F.col("high_a")[k], F.lit(0.0)), 2) for k in range(BOXED)),
        F.lit(0.0),
    )
    near = a.join(b, ["label", "dim", "cell"]).where((F.col("a") <= F.col("b")) & (gap <= reach**2 + SLACK))
    pairs = stored(near.select("a", "b").distinct(), "near-pairs")
    body = made.select(tile.alias("tile"), "ids", "weights", "matrix")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        l, r = left.to_pylist()[0], right.to_pylist()[0]
        ids, other = np.frombuffer(l["ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
        w, w_other = np.frombuffer(l["weights"], "<i8"), np.frombuffer(r["weights"], "<i8")
        x = np.frombuffer(l["matrix"], "<f8").reshape(len(ids), -1)
        y = np.frombuffer(r["matrix"], "<f8").reshape(len(other), -1)
        i, j = near_pairs(x, y, turns.value[x.shape[1]], threshold)
        if l["tile"] == r["tile"]:
            i, j = i[i != j], j[i != j]
            links = np.bincount(i, w[j], len(ids)).astype(np.int64)
            names = ids
        else:
            links = np.r_[np.bincount(i, w_other[j], len(ids)), np.bincount(j, w[i], len(other))].astype(np.int64)
            names, j = np.r_[ids, other], j + len(ids)
        root = roots(len(names), i, j)
        own = np.flatnonzero(links)
        return pa.table({"id": names[own], "links": links[own], "root": names[root[own]]})

    # A pair's two sides as tables of their own, or Spark takes the columns of one for those of the other.
    side = lambda own: pairs.join(body, F.col(own) == F.col("tile")).select(
        *[F.col(c).alias(c) for c in ("a", "b", "tile", "ids", "weights", "matrix")]
    )
    lefts, rights = side("a"), side("b")
    met = stored(lefts.groupBy("a", "b").cogroup(rights.groupBy("a", "b")).applyInArrow(meet, MET), "near-met")
    degree = met.groupBy("id").agg(F.sum("links").alias("more"))
    component = connected(met.select(F.col("id").alias("a"), F.col("root").alias("b")), "near-components")
    linked = component.join(groups.select(F.col("rep").alias("id"), F.col("id").alias("vec")), "id")
    least = linked.groupBy("root").agg(F.min("vec").alias("component_id"), F.count("*").alias("n"))
    # A component of any size is met in places in proportion to it.
    named = salted_join(linked, least.drop("n"), "root", least.select("root", "n"), how="inner", spread=["id"])
    component = named.join(degree, "id").select(F.col("id").alias("rep"), "component_id", "more")
    known = groups.select("group", "rep", "id", "weight").join(component, "rep", "left").select(
        "group",
        (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    joined = hot_key_join(given.select("id", "group"), known, "group", how="left", spread=["id"])
    out = joined.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
