"""Merkle dataset manifest: a digest per row, per group and of the whole table, and a proof per row by pointer jumping.

The rows of a group, in the order of their ids, are the leaves of its tree; two consecutive nodes become their parent's
digest, and a last single one becomes a parent of its own. The groups' roots, in order, are the leaves of the top tree.

Digests rise a block at a time: BLOCK_BITS levels over 2^BLOCK_BITS nodes are one row's work, so a tree of any size takes a
few rounds. Every node then holds the digest of its sibling, a segment of one step towards the root. In each round the
nodes join themselves: a node takes over the segment of the ancestor where its own ends, which doubles its reach, until
every leaf reaches the root. After a round only the nodes on every second of its levels are still asked for, so the
rounds together carry little more than the leaves. An ancestor that many nodes ask for is copied once per CHUNK leaves
below it, and each node asks the copy of its own chunk; a group with any share of the rows is spread over its chunks.

A null column counts as `-`. Rows that share an id are leaves of their own, in the order of their digests; null ids come
first, and so does the null group. A lone leaf is its group's root and proves itself with no siblings; an empty table
gives no rows. Very long texts are hashed whole where they are read. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladefreq.llm.common import numbered, stored

#: Levels that a block of nodes rises at once.
BLOCK_BITS = 10
#: Leaves below an ancestor that share one copy of it, as a power of two.
CHUNK_BITS = 14


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of texts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def _parents(nodes: Column) -> Column:
    """Digests of two consecutive nodes each."""
    return F.transform(
        F.sequence(F.lit(0), F.call_function("div", F.size(nodes) - 1, F.lit(2)).cast("int")),
        lambda i: digest(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit(""))),
    )


def forest(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Trees over rows (tree, n, pos, digest): nodes below the roots (tree, n, level, pos, segment) with the sibling's
    digest as bytes, empty where there is none; roots (tree, n, root); and the number of levels of the highest tree."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, base = max(most - 1, 0).bit_length(), 0
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    now, nodes, roots = leaves.select("tree", "n", "pos", "digest"), [], []
    while True:
        blocks = now.groupBy("tree", "n", _right(F.col("pos"), F.lit(BLOCK_BITS)).alias("block")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("own")
        )
        steps = F.greatest(F.lit(0), F.least(F.lit(BLOCK_BITS), height - base))
        rounds = F.slice(F.array(*[F.lit(k) for k in range(BLOCK_BITS)]), F.lit(1), steps)
        risen = blocks.select(
            "tree", "n", "block", steps.alias("steps"),
            F.aggregate(rounds, F.array("own"), lambda up, _: F.array_append(up, _parents(F.element_at(up, -1)))).alias("up"),
        )
        risen = stored(risen, f"{name}-blocks")
        place = lambda k, i: F.call_function("shiftleft", F.col("block"), F.lit(BLOCK_BITS) - k) + i
        own = F.transform(
            F.slice("up", F.lit(1), F.col("steps")),
            lambda nodes_, k: F.transform(
                nodes_,
                lambda _, i: F.struct(
                    (k + base).alias("level"), place(k, i).alias("pos"),
                    F.coalesce(F.unhex(F.get(nodes_, i.bitwiseXOR(F.lit(1)))), F.lit(b"")).alias("segment"),
                ),
            ),
        )
        nodes.append(risen.select("tree", "n", F.inline(F.flatten(own))))
        top = F.element_at(F.element_at("up", -1), 1)
        roots.append(risen.where((height >= base) & (height <= base + BLOCK_BITS) & ((height > base) | (F.lit(base) == 0))).select("tree", "n", top.alias("root")))
        base += BLOCK_BITS
        if base >= levels:
            break
        now = risen.where(height > base).select("tree", "n", F.col("block").alias("pos"), top.alias("digest"))
    every, found = nodes[0], roots[0]
    for more, last in zip(nodes[1:], roots[1:], strict=True):
        every, found = every.union(more), found.union(last)
    return every, found, levels


def proofs(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """Per leaf (tree, n, pos) the siblings up to its root as one segment of bytes, by pointer jumping."""
    chunk = lambda leaf: _right(leaf, F.lit(CHUNK_BITS))
    first = lambda pos, level: F.call_function("shiftleft", pos, level)
    nodes, reach = stored(nodes, f"{name}-nodes"), 1
    while reach < levels:
        asking = nodes.where(F.col("level") % (2 * reach) == 0).select(
            "tree", "n", "level", "pos", "segment", (F.col("level") + reach).alias("to"),
            _right(F.col("pos"), F.lit(reach)).alias("above"), chunk(first(F.col("pos"), F.col("level"))).alias("chunk"),
        )
        last = F.least(first(F.col("pos") + 1, F.col("level")), F.col("n")) - 1
        asked = nodes.where(F.col("level") % (2 * reach) == reach).select(
            "tree", F.col("level").alias("to"), F.col("pos").alias("above"), F.col("segment").alias("further"),
            F.explode(F.sequence(chunk(first(F.col("pos"), F.col("level"))), chunk(last))).alias("chunk"),
        )
        # Who finds no ancestor there has reached the root.
        met = asking.join(asked, ["tree", "to", "above", "chunk"], "left")
        segment = F.concat("segment", F.coalesce("further", F.lit(b"")))
        nodes = stored(met.select("tree", "n", "level", "pos", segment.alias("segment")), f"{name}-reach")
        reach *= 2
    return nodes.where("level = 0").select("tree", "n", "pos", "segment")


def _rise(pos: Column, n: Column, segment: Column) -> Callable[[Column, Column], Column]:
    """One level of a fold: (digest now, place of the next sibling in the segment) and the level to those above it."""
    one = F.lit(1).cast("long")

    def step(state: Column, level: Column) -> Column:
        place = _right(pos, level)
        width = _right(n + F.call_function("shiftleft", one, level) - 1, level)
        has = place.bitwiseXOR(one) < width
        other = F.when(has, F.lower(F.hex(F.substring(segment, state["at"], F.lit(32))))).otherwise(F.lit(""))
        left = place.bitwiseAND(one) == 1
        pair = F.when(left, F.concat(other, state["now"])).otherwise(F.concat(state["now"], other))
        at = F.when(has, state["at"] + 32).otherwise(state["at"])
        return F.struct(F.sha2(pair, 256).alias("now"), at.alias("at"))

    return step


def fold(leaf: Column, steps: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Digest that a leaf and its siblings lead to, through trees (place, leaves, segment) from the lowest to the top."""
    now = leaf
    for pos, n, segment in steps:
        levels = F.when(n > 1, F.sequence(F.lit(0), F.length(F.bin(n - 1)) - 1)).otherwise(F.array().cast("array<int>"))
        start = F.struct(now.alias("now"), F.lit(1).alias("at"))
        now = F.aggregate(levels, start, _rise(pos, n, segment), lambda state: state["now"])
    return now


def manifest(
    docs: DataFrame,
    leaf: Column,
    claimed: Column,
    group_col: str = "lang",
    id_col: str = "doc_id",
) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root and verified.

    `leaf` is the digest of the row as the manifest holds it, `claimed` the digest of the row as it is presented, which
    `folded_root` follows up with the manifest's siblings; `verified` says whether that leads to the root.
    """
    # Without a null: the null group's name comes first of all.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), tree.alias("tree"), leaf.alias("digest"), claimed.alias("claimed")), "manifest-leaves")
    leaves = numbered(rows, "tree", [F.col("id").asc_nulls_first(), F.col("digest")])
    nodes, subroots, levels = forest(leaves, "manifest")
    segments = proofs(_with_alone(nodes, leaves), levels, "manifest")
    tops = numbered(subroots.select("tree", F.col("root").alias("digest"), F.lit("").alias("top")), "top", [F.col("tree")])
    tops = tops.select("tree", F.col("top"), "n", "pos", "digest")
    above, roots, height = forest(tops.select(F.col("top").alias("tree"), "n", "pos", "digest"), "manifest-top")
    upper = proofs(_with_alone(above, tops.select(F.col("top").alias("tree"), "n", "pos")), height, "manifest-top")
    root = roots.select("root").agg(F.max("root")).scalar()
    groups = tops.join(upper.select("pos", F.col("segment").alias("top_segment")), "pos").select(
        "tree", F.col("digest").alias("subroot"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"), "top_segment"
    )
    # The last jump, from a group's root to the whole table's: a group is copied once per chunk of its leaves.
    counts = subroots.select("tree", F.col("n").alias("size"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), _right(F.col("size") - 1, F.lit(CHUNK_BITS))))
    groups = groups.join(counts, "tree").withColumn("chunk", copies).drop("size")
    whole = leaves.join(segments.select("tree", "pos", "segment"), ["tree", "pos"])
    whole = whole.withColumn("chunk", _right(F.col("pos"), F.lit(CHUNK_BITS))).join(groups, ["tree", "chunk"])
    path = [(F.col("pos"), F.col("n"), F.col("segment")), (F.col("top_pos"), F.col("top_n"), F.col("top_segment"))]
    out = whole.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", root.alias("root"),
        F.sha2(F.lower(F.hex(F.concat("segment", "top_segment"))), 256).alias("proof_sha256"),
        fold(F.col("claimed"), path).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _alone(leaves: DataFrame) -> DataFrame:
    """Leaves that are roots themselves, as nodes with an empty segment."""
    return leaves.where("n = 1").select(
        "tree", "n", F.lit(0).alias("level"), "pos", F.lit(b"").alias("segment")
    )


def _with_alone(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    return nodes.where("n > 1").union(_alone(leaves))
