"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf of the tree holds the rank of the pair that starts at its position, and each inner node the smallest rank below
it, leftmost first; the root is the next merge. A merge changes three leaves: its own, that of the neighbour before it,
and that of the part it swallows. Each is a logarithmic update. Matches of up to 256 bytes are merged side by side, those
of one tree size together; longer ones one by one. Ids of repeated matches are kept in a bounded table.

A null text counts as empty and has no ids; null and repeated ids are encoded row by row; a very long text, or one that
is a single match, is encoded whole; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladefreq.llm.pieces import BYTE_LEVEL, BYTE_LEVEL_PATTERN, KEPT, OTHER

NONE = np.int64(1) << 62
#: Bits of an id in the name of a pair, and of a position in a leaf below its rank: matches of up to 2^40 bytes.
SHIFT = 24
PLACE = 40
MAX_RANK = 1 << 22
SIDE_BY_SIDE = 256
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


class Bpe:
    """Ranks of one vocabulary. `ranks`: token bytes to id, which is also the order of merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if max(ranks.values(), default=0) >= MAX_RANK:
            raise ValueError(f"ranks of {MAX_RANK} and more are not supported")
        self.ranks, self.pattern, self.is_plain = ranks, regex.compile(pattern), pattern == BYTE_LEVEL_PATTERN
        self.tokens = {i: t for t, i in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << SHIFT | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf of the pair (left, right) at a position; NONE if they don't merge or one is missing (-1)."""
        key = left << SHIFT | right
        found = np.searchsorted(self.keys, key)
        np.minimum(found, len(self.keys) - 1, out=found)
        hit = (self.keys[found] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.values[found] << PLACE | at, NONE)

    def _side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        """Merge words of at most `width` bytes (a power of two), one tree each, all trees in step."""
        n = len(words)
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        place = np.arange(width)
        # A place for "no part" after the last position: id -1, and links that point to it.
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(place < lengths[:, None], self.bytes[raw], -1)
        after = np.tile(np.minimum(place + 1, width), (n, 1))
        after = np.where(after < lengths[:, None], after, width)
        after = np.concatenate([after, np.full((n, 1), width)], 1)
        before = np.tile(np.r_[width, place[:-1], width], (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = self._rank(ids[:, :width].ravel(), ids[:, 1:].ravel(), np.tile(place, n)).reshape(n, width)
        step = width
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root & ((1 << PLACE) - 1), root >> PLACE
            gone = after[live, at]
            then = after[live, gone]
            prior = before[live, at]
            ids[live, at] = rank
            after[live, at] = then
            before[live, then] = at
            before[live, width] = width
            leaves = (
                (gone, np.full(len(live), NONE)),
                (at, self._rank(rank, ids[live, then], at)),
                (prior, self._rank(ids[live, prior], rank, prior)),
            )
            ids[live, gone] = -1
            for leaf, value in leaves:
                own = leaf < width
                row, node = live[own], leaf[own] + width
                tree[row, node] = value[own]
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        left = ids[:, :width]
        keep = left >= 0
        flat, ends = left[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)) * 4
        return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def _alone(self, word: bytes) -> bytes:
        """The same for one long word, on plain lists."""
        n, get, none = len(word), self.pairs.get, int(NONE)
        width = 1 << (n - 1).bit_length()
        ids = [*self.bytes[np.frombuffer(word, np.uint8)].tolist()]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(at: int, then: int) -> int:
            rank = get(ids[at] << SHIFT | ids[then]) if then < n else None
            return none if rank is None else rank << PLACE | at

        tree = [none] * width + [leaf(k, k + 1) for k in range(n)] + [none] * (width - n)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < none:
            at, rank = tree[1] & ((1 << PLACE) - 1), tree[1] >> PLACE
            gone = after[at]
            then, prior = after[gone], before[at]
            ids[at], ids[gone], after[at] = rank, -1, then
            if then < n:
                before[then] = at
            changed = [(gone, none), (at, leaf(at, then))]
            if prior >= 0:
                changed.append((prior, leaf(prior, at)))
            for k, value in changed:
                k += width
                tree[k] = value
                k >>= 1
                while k:
                    tree[k] = min(tree[2 * k], tree[2 * k + 1])
                    k >>= 1
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (little-endian unsigned 32 bits); a word that is a token is that token."""
        out: list[bytes | None] = [None] * len(words)
        sizes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if (rank := self.ranks.get(w)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(w) <= SIDE_BY_SIDE:
                sizes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(k)
            else:
                out[k] = self._alone(w)
        for width, own in sizes.items():
            for a in range(0, len(own), step := max(1, (1 << 18) // width)):
                part = own[a : a + step]
                for k, ids in zip(part, self._side_by_side([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _matches(self, text: str) -> list[str]:
        return [m.group() for m in self.pattern.finditer(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each match of the pattern separately."""
        # BYTE_LEVEL states the matches of that one pattern for the characters that OTHER leaves out.
        lists = [BYTE_LEVEL.findall(t) if self.is_plain and not OTHER.search(t) else self._matches(t) for t in texts]
        missing = list(set().union(*lists) - self.known.keys())
        rare = dict(zip(missing, self.words([m.encode() for m in missing]), strict=True))
        if len(self.known) < KEPT:
            self.known.update(rare)
            rare = {}
        known, other = self.known, rare
        return [b"".join([known[m] if m in known else other[m] for m in x]) for x in lists]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(1)
def bpe(path: str, pattern: str) -> Bpe:
    """One vocabulary per worker; `path` is readable on every executor."""
    return Bpe(load_ranks(path), pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32 bits) and the bytes decoded from them; with `digests` the SHA-256
    of both instead."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                own = batch.slice(k, 512)
                ids = codec.encode(own.column(1).to_pylist())
                back = [codec.decode(x) for x in ids]
                if digests:
                    both = [pa.array([hashlib.sha256(b).hexdigest() for b in x], pa.string()) for x in (ids, back)]
                else:
                    both = [pa.array(x, pa.binary()) for x in (ids, back)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *both], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    names = [x.split()[0] for x in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(encoded, schema)
