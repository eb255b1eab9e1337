"""Packing: token windows of near-equal size by Karmarkar-Karp multiway differencing.

Documents are tokenized, cut at the capacity where they exceed it, and gathered into groups of about a million ids. In
each group every piece starts as a partition of its own whose other windows are empty; the two partitions of widest
spread are merged again and again, fullest windows meeting emptiest, until one is left. If a window then exceeds the
capacity, the group gets one window more and is differenced anew. A group fits in memory whatever the input is.

Null texts count as empty, so they hold the end id alone; null or repeated ids and equal rows are packed like any others,
a piece per row. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladefreq.llm.pieces import encoder

#: Ids gathered before a group is differenced.
GROUP_IDS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<long>"
#: Sequence ids are unique over partitions: partition number times this, plus a count within it.
PER_PARTITION = 1 << 40


def _merged(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two partitions merged with opposing imbalances, in descending order, and where each came from."""
    size = min(k, len(a) + len(b))
    sums = np.zeros(size, np.int64)
    sums[: len(a)] += a
    sums[size - len(b) :] += b[::-1]
    order = np.argsort(-sums, kind="stable")
    return sums[order], order


def difference(sizes: list[int], k: int) -> np.ndarray:
    """Window (0 to k - 1) of each size, by multiway differencing; deterministic, ties by order."""
    nodes: list[tuple] = [(np.array([s], np.int64),) for s in sizes]
    heap = [(-s, i) for i, s in enumerate(sizes)] if k > 1 else [(0, i) for i in range(len(sizes))]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        sums, order = _merged(nodes[i][0], nodes[j][0], k)
        nodes.append((sums, order, i, j))
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-int(spread), len(nodes) - 1))
    window = np.zeros(len(sizes), np.int64)
    # From the last merge down: the window that each slot of a node has become.
    at = {len(nodes) - 1: np.arange(len(nodes[-1][0]))} if nodes else {}
    for n in range(len(nodes) - 1, -1, -1):
        slots = at.pop(n)
        if len(nodes[n]) == 1:
            window[n] = slots[0]
            continue
        _, order, i, j = nodes[n]
        left, right = len(nodes[i][0]), len(nodes[j][0])
        was = np.empty(len(order), np.int64)
        was[order] = slots
        at[i], at[j] = was[:left], was[::-1][:right]
    return window


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """Window of each size so that no window exceeds `capacity`; starts from the fewest windows that could do."""
    if max(sizes, default=0) > capacity:
        raise ValueError("a piece is larger than the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if not sizes or np.bincount(found, weights=sizes).max() <= capacity:
            return found
        k += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 4096,
    lower: bool = True,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` its ids."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, lower), np.array([end_id], "<u4").tobytes()
        first, count, pieces, held = TaskContext.get().partitionId() * PER_PARTITION, 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal count
            full = [p for p in pieces if len(p[2]) == 4 * capacity]
            rest = [p for p in pieces if len(p[2]) < 4 * capacity]
            found = windows([len(p[2]) // 4 for p in rest], capacity)
            _, found = np.unique(found, return_inverse=True)
            at: dict[int, int] = {}
            rows = []
            for (key, start, blob, total), w in zip(full + rest, [*range(len(full)), *(found + len(full))], strict=True):
                n, w = len(blob) // 4, int(w)
                rows.append((key, start, n, zlib.crc32(blob), total, first + count + w, at.get(w, 0), blob))
                at[w] = at.get(w, 0) + n
            count += len(at)
            pieces.clear()
            columns = list(zip(*rows, strict=True))
            ids = [np.frombuffer(b, "<u4").astype(np.int64) for b in columns[7]] if with_ids else [None] * len(rows)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(ids, pa.list_(pa.int64()))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = batch.slice(k, 512)
                for key, blob in zip(own.column(0).to_pylist(), encode(own.column(1).to_pylist()), strict=True):
                    blob += end
                    total = len(blob) // 4
                    for start in range(0, total, capacity):
                        piece = blob[4 * start : 4 * (start + capacity)]
                        pieces.append((key, start, piece, total))
                        held += len(piece) // 4
                        if held >= GROUP_IDS:
                            yield close()
                            held = 0
        if pieces:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = rows.mapInArrow(packed, SCHEMA)
    return out if with_ids else out.drop("ids")
