"""MinHash near-dedup: BagMinHash signatures, bands, and verified overlap of word-shingle multisets.

Equal texts are one group with one signature. Groups that share a band form a bucket. First the members of every bucket
are compared with the bucket's smallest one, by their exact overlap, which joins nearly all copies of a text. In buckets
that then still hold two classes, every two members of different classes are compared too, unless so few of their
registers agree that an overlap of the threshold is out of reach (SLACK standard deviations), or an earlier band has both.
Such a bucket is laid out by class and cut into tiles; a task meets two tiles, and tiles of one and the same class never
meet. So a bucket of any size is spread, copies of a text cost little more than one comparison each, and pairs of unlike
classes are all looked at.

Bands of 7 registers, 28 of them: two texts whose overlap is 0.8 share one with probability 0.9986, more similar ones more
often. Null and empty texts link with nothing. A text without words links with its exact copies only. Rows that share an
id are documents of their own; a class is named by its smallest id, ids that are null last. Very long texts are compared
whole. An empty table gives no rows. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladefreq.llm.bagminhash import bands, overlap, shingles, signatures
from cladefreq.llm.common import connected, discard, numbered, release, stored
from cladefreq.operators.joins import hot_key_join, salted_join

ROWS, BANDS = 7, 28
REGISTERS = ROWS * BANDS
#: Standard deviations of the share of agreeing registers below the threshold at which a pair is still compared.
SLACK = 3.5
#: Members of a bucket that are one side of a comparison of tiles.
TILE = 256
#: Texts hashed or compared together have about so many characters; a longer one is alone.
GROUP_CHARS = 1 << 19


def digest(text_col: str) -> F.Column:
    """Name of a text's group of equal texts; null for null and empty texts."""
    return F.when(F.length(text_col) > 0, F.unhex(F.md5(F.col(text_col).cast("binary"))))


def _slices(texts: list[str]) -> Iterator[slice]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > GROUP_CHARS:
            yield slice(start, k)
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _signed(rows: DataFrame) -> DataFrame:
    """doc, digest, band hashes and sketch (a byte of each register) of rows (doc, digest, text)."""
    names = ["doc", "digest", "bands", "sketch"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for own in _slices(texts):
                n = own.stop - own.start
                of, hashes, counts = shingles(texts[own])
                registers = signatures(of, hashes, counts, n, REGISTERS)
                has = np.bincount(of, minlength=n) > 0
                found = bands(registers, ROWS)
                # The lowest bits of a time are as good as random.
                marks = (registers & np.uint64(0xFF)).astype(np.uint8)
                part = batch.slice(own.start, n)
                lists = [row if h else None for row, h in zip(found.tolist(), has.tolist(), strict=True)]
                sketches = [m.tobytes() if h else None for m, h in zip(marks, has.tolist(), strict=True)]
                columns = [part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return rows.mapInArrow(signed, "doc long, digest binary, bands array<long>, sketch binary")


def _overlapping(left: list[str], right: list[str], threshold: float) -> np.ndarray:
    """Which pairs overlap enough."""
    out = np.zeros(len(left), bool)
    for own in _slices([x + y for x, y in zip(left, right, strict=True)]):
        out[own] = overlap(left[own], right[own]) >= threshold - 1e-12
    return out


def _verified(pairs: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """Pairs (leader, member) whose texts overlap enough: a, b."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_overlapping(batch.column(2).to_pylist(), batch.column(3).to_pylist(), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    # The member's text travels once per leader; a leader's text is copied to where the members of a hot leader are.
    member = pairs.join(bodies.select(F.col("rep").alias("b"), F.col("text").alias("right")), "b")
    leader = bodies.select(F.col("rep").alias("a"), F.col("text").alias("left"))
    both = hot_key_join(member, leader, "a", how="inner", spread=["b"], counted=pairs)
    return both.select("a", "b", "left", "right").mapInArrow(checked, "a long, b long")


def _links_of_group(rows: list[tuple], threshold: float, floor: float) -> Iterator[tuple[int, int]]:
    """Links between rows (band, tile, rep, root, sketch, text) of two tiles of a bucket, or of one, in different classes."""
    band, tiles, reps = rows[0][0], np.array([r[1] for r in rows]), [r[2] for r in rows]
    _, roots = np.unique([r[3] for r in rows], return_inverse=True)
    sketches = np.array([np.frombuffer(r[4], np.uint8) for r in rows])
    two = tiles.min() != tiles.max()
    i, j = np.triu_indices(len(rows), 1)
    keep = roots[i] != roots[j]
    if two:
        keep &= tiles[i] != tiles[j]
    i, j = i[keep], j[keep]
    chosen = []
    for k in range(0, len(i), 1 << 14):
        a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        agree = sketches[a] == sketches[b]
        # A pair counts in the first band that it shares.
        first = agree.reshape(len(a), BANDS, ROWS).all(2).argmax(1) == band
        share = agree.mean(1)
        fine = np.flatnonzero(first & (share >= floor))
        chosen.append(np.stack([a[fine], b[fine], (share[fine] * REGISTERS).round().astype(np.int64)]))
    if not chosen:
        return
    i, j, share = np.concatenate(chosen, axis=1)
    order = np.argsort(-share, kind="stable")
    i, j = i[order], j[order]
    # The likeliest pairs of each two classes first; what they join needs no more comparing.
    while len(i):
        low, high = np.minimum(roots[i], roots[j]), np.maximum(roots[i], roots[j])
        _, first = np.unique(low * (int(roots.max()) + 1) + high, return_index=True)
        a, b = i[first].tolist(), j[first].tolist()
        hit = _overlapping([rows[x][5] for x in a], [rows[x][5] for x in b], threshold)
        for x, y, h in zip(a, b, hit.tolist(), strict=True):
            if h:
                yield reps[x], reps[y]
                if roots[x] != roots[y]:
                    roots[roots == max(roots[x], roots[y])] = min(roots[x], roots[y])
        rest = np.ones(len(i), bool)
        rest[first] = False
        rest &= roots[i] != roots[j]
        i, j = i[rest], j[rest]


def _between_classes(members: DataFrame, roots: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """Links between members (key, band, rep) of one bucket whose classes (rep, root) differ: a, b."""
    known = members.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    counts = known.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = counts.where("low < high").select("key")
    known = salted_join(known, mixed, "key", counts.select("key", "n"), how="inner", spread=["rep"])
    placed = numbered(known, "key", [F.col("root"), F.col("rep")])
    # Tiles that hold one class only are an interval for each class; they don't meet each other.
    classed = placed.withColumn("of", F.xxhash64("key", "root"))
    spans = classed.groupBy("of", "root").agg(
        F.count("*").alias("n_of"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    counts = spans.groupBy("of").agg(F.sum("n_of").alias("n"))
    spans = spans.groupBy("of").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spread = salted_join(classed, spans, "of", counts, how="inner", spread=["rep"])
    div = lambda x, y: F.call_function("div", x, F.lit(y))
    tile = div(F.col("pos"), TILE)
    spread = spread.select(
        "key", "band", "rep", "root", tile.alias("tile"), div(F.col("n") - 1, TILE).alias("tiles"),
        div(F.col("first") + TILE - 1, TILE).alias("lo"), (div(F.col("last") + 1, TILE) - 1).alias("hi"),
    )
    pure = F.col("tile").between(F.col("lo"), F.col("hi"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles")), lambda u: ~(pure & u.between(F.col("lo"), F.col("hi"))))
    dealt = spread.withColumn("other", F.explode(others)).select(
        "key", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "band", "tile", "rep", "root"
    )
    rows = dealt.join(bodies, "rep").select("key", "t", "u", "band", "tile", "rep", "root", "sketch", "text")
    floor = threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def close() -> list[tuple[int, int]]:
            found = list(_links_of_group(held, threshold, floor)) if len(held) > 1 else []
            held.clear()
            return found

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != last:
                    out += close()
                last = row[:3]
                held.append(row[3:])
            yield _links(out)
        if held:
            yield _links(close())

    ordered = rows.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u")
    return ordered.mapInArrow(linked, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def near_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of near copies, stored: rows (doc, digest) of all documents, and groups (digest, class_id, leads), where
    `leads` marks the group of the class's smallest id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    signed = stored(_signed(rows), "near-signed")
    one = F.struct("bands", "sketch")
    groups = signed.where("digest is not null").groupBy("digest").agg(F.min("doc").alias("doc"), F.first(one).alias("one"))
    groups = groups.select("digest", "doc", F.col("one.bands").alias("bands"), F.col("one.sketch").alias("sketch"))
    groups = stored(groups.withColumn("rep", F.monotonically_increasing_id()), "near-groups")
    rows_of = groups.where("bands is not null").select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = rows_of.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader"))
    # Only buckets of two groups or more; a bucket's leader comes along.
    shared = sizes.where("n > 1").select("key", "leader")
    members = stored(
        salted_join(rows_of, shared, "key", sizes.select("key", "n"), how="inner", spread=["rep"]), "near-members"
    )
    wanted = members.select("rep").distinct().join(groups.select("rep", "digest", "sketch"), "rep")
    # An aggregate before the join, so that a text of many copies leaves each task once.
    texts = rows.where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"))
    bodies = stored(wanted.join(texts, "digest").select("rep", "sketch", "text"), "near-bodies")
    pairs = stored(members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "near-pairs")
    links = stored(_verified(pairs, bodies.select("rep", "text"), threshold), "near-links")
    discard(pairs)
    roots = stored(connected(links, "near-roots").select(F.col("id").alias("rep"), "root"), "near-roots")
    more = stored(_between_classes(members.select("key", "band", "rep"), roots, bodies, threshold), "near-links")
    discard(members, bodies, roots)
    component = connected(links.union(more), "near-roots").select(F.col("id").alias("rep"), "root")
    named = groups.select("digest", "doc", "rep").join(component, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = named.groupBy("root").agg(
        F.count("*").alias("n"),
        F.min("doc").alias("class_id"),
        F.min_by("rep", F.struct(F.col("doc").isNull(), "doc", "rep")).alias("first"),
    )
    met = salted_join(named, least.drop("n"), "root", least.select("root", "n"), how="inner", spread=["rep"])
    classes = stored(met.select("digest", "class_id", (F.col("rep") == F.col("first")).alias("leads")), "near-classes")
    discard(groups, links, more)
    return signed.select("doc", "digest"), classes


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id of its class) and kept (whether it names its class), one row per document."""
    members, classes = near_classes(docs, threshold, id_col, text_col)
    joined = hot_key_join(members, classes.select("digest", "class_id"), "digest", how="left", spread=["doc"])
    out = joined.select(F.col("doc").alias("doc_id"), F.coalesce("class_id", "doc").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near copies: of each class one row stays, that of the smallest id; null and empty texts
    all stay. Of rows that share that id and text one stays. Columns keep their names, whatever these are."""
    _, classes = near_classes(docs, threshold, id_col, text_col)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"))
    named = docs.select(every.alias("row"), digest(text_col).alias("digest"), key.alias("key"))
    leads = classes.where("leads").select(F.col("digest").alias("lead"))
    # The smallest row of each text is found on the map side; then one row per text meets the classes.
    first = named.where("digest is not null").groupBy("digest").agg(F.min_by("row", "key").alias("row"))
    kept = first.join(leads, F.col("digest") == F.col("lead"), "left_semi").select("row")
    return kept.unionByName(named.where("digest is null").select("row")).select("row.*")
