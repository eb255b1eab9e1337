"""Suffix-array dedup: bytes of passages that an earlier document holds too, found by deep-shallow suffix sorting.

Every string of `length` bytes (a window) is named by the least hash of its short grams, so equal windows have equal names
wherever they stand. A run of windows of one name is a segment. The documents are stored in batches, and three rounds
pass between batches and buckets of names:

1. Each batch sends the names of its segments, nothing else; a bucket answers with two bits per name: whether another
   document has it, and whether it is crowded, with more than CROWDED segments.
2. Each batch sends the bytes of its distinct segments of shared names, and where they stand. Of a crowded name it sends
   every distinct window by itself, to the bucket of its own hash, so no task meets a name's unlike contexts together.
   A bucket sorts the suffixes that begin in its segments: multikey quicksort over eight-byte characters to a shallow
   depth, then a blind trie for each group that still agrees. Windows that stay together to the full depth are equal, and
   each learns the smallest document id among them. The bucket answers with the spans to remove.
3. Each batch cuts its documents.

What travels are blobs of numbers and bytes, ten names or more each: the sizes of batches and buckets both grow with the
square root of the input, from 4 MB to 140 MB at 100 TB. Texts, however long, are cut and hashed a quarter of a megabyte at a time.
Batches are rows of a stored table, so a lost executor costs the tasks it ran.

Segments are told apart by 64-bit hashes and compared byte by byte before two count as one; names only decide where
windows meet. Null texts count as empty; a text shorter than `length` loses nothing. Rows that share an id do not remove
from each other; a null id counts as larger than all others. An empty table gives no rows. Extra columns stay, except
that ones called n_bytes, n_removed, n_spans, kept or kept_text are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladefreq.llm.bagminhash import BASE, BYTE_VALUES, INVERSE, mix
from cladefreq.llm.common import release, stored

#: Bytes of the grams that name a window: longer ones are seldom shared by chance, shorter ones make fewer segments.
GRAM = 24
SHALLOW = 16
#: Least bytes of text in a batch or bucket, and bytes per name and document on which their growth rests.
BATCH_BYTES, PER_BLOB = 1 << 22, 200
#: A bucket's share of the names of so many times fewer bytes than a batch has.
BUCKETS_PER_BATCH = 4
#: Bytes that are cut into segments, hashed or compared together.
SLICE = 1 << 18
#: Windows of a segment; a longer run of one name is cut.
SEGMENT_WINDOWS = 1 << 10
#: Segments of a name in all documents before its windows are dealt out one by one.
CROWDED = 1 << 16
#: Windows sorted together, but for those of one name.
SORTED = 1 << 17
#: Places of segments whose windows are looked through together.
PLACES = 1 << 12
NAME_BYTES = 6
LAST = (1 << 63) - 1
ADDED = ("n_bytes", "n_removed", "n_spans", "kept", "kept_text")


def _words(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    out = np.empty(max(len(data) - 7, 0), np.uint64)
    raw = data.tobytes()
    for k in range(min(8, len(out))):
        n = (len(data) - k) // 8
        out[k::8] = np.frombuffer(raw, ">u8" if big else "<u8", n, k)
    return out


class Hashes:
    """Hashes of any stretch of bytes, by differences of running sums."""

    def __init__(self, data: np.ndarray) -> None:
        powers = np.full(len(data) + 1, BASE, np.uint64)
        powers[0] = 1
        self.running = np.r_[np.uint64(0), np.cumsum(BYTE_VALUES[data] * np.cumprod(powers[:-1]))]
        powers[1:] = INVERSE
        self.back = np.cumprod(powers)

    def __call__(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        sums = self.running[starts + sizes] - self.running[starts]
        return mix(sums * self.back[starts] + sizes.astype(np.uint64))


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and per segment its text, start among all bytes, number of windows and name; also texts' offsets."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return data, none, none, none, none.astype(np.uint64), offsets
    gram = min(GRAM, length)
    if gram >= 8:
        words = _words(data)
        count = len(data) - gram + 1
        grams = np.zeros(count, np.uint64)
        for at in sorted({*range(0, gram - 7, 8), gram - 8}):
            grams = grams * BASE + words[at : at + count]
        grams = mix(grams)
    else:
        grams = Hashes(data)(np.arange(len(data) - gram + 1), np.full(len(data) - gram + 1, gram))
    span, have = length - gram + 1, 1
    while have * 2 <= span:
        grams = np.minimum(grams[:-have], grams[have:])
        have *= 2
    rest = span - have
    names = np.minimum(grams[: len(grams) - rest], grams[rest:])[:n]
    last = np.zeros(n + 1, bool)
    inside = np.zeros(len(data) + 1, np.int32)
    long = sizes >= length
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, (offsets + sizes - length + 1)[long], -1)
    inside = np.cumsum(inside)[:n] > 0
    # A run ends where the name changes, where the text ends or where its windows do.
    last[0] = last[n] = True
    last[1:n] = (names[1:] != names[:-1]) | (inside[1:] != inside[:-1])
    begins = offsets[long]
    last[begins[begins < n]] = True
    edges = np.flatnonzero(last)
    pieces = -(-np.diff(edges) // SEGMENT_WINDOWS)
    if len(pieces) and pieces.max() > 1:
        first = np.cumsum(pieces) - pieces
        within = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        edges = np.r_[np.repeat(edges[:-1], pieces) + within * SEGMENT_WINDOWS, n]
    starts, counts = edges[:-1], np.diff(edges)
    keep = inside[starts]
    starts, counts = starts[keep], counts[keep]
    of = np.searchsorted(offsets, starts, side="right") - 1
    return data, of, starts, counts, names[starts], offsets


class BlindTrie:
    """Strings of one length in order: inner nodes hold the place where their children part, leaves the members of a class."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, text: bytes, member: int) -> None:
        """An inner node is [place, children by byte]; a leaf is [None, text, members]."""
        if self.root is None:
            self.root = [None, text, [member]]
            return
        # Blindly down to a leaf: only the bytes where paths part are looked at.
        node = self.root
        while node[0] is not None:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[1] == text:
            node[2].append(member)
            return
        apart = int.from_bytes(node[1], "big") ^ int.from_bytes(text, "big")
        place = len(text) - 1 - (apart.bit_length() - 1) // 8
        byte_there = node[1][place]
        # Down again to where the string parts from all that is there.
        parent, key, node = None, 0, self.root
        while node[0] is not None and node[0] < place:
            parent, key = node, text[node[0]]
            node = node[1][key]
        leaf = [None, text, [member]]
        if node[0] == place:
            node[1][text[place]] = leaf
            return
        inner = [place, {byte_there: node, text[place]: leaf}]
        if parent is None:
            self.root = inner
        else:
            parent[1][key] = inner

    def classes(self) -> Iterator[list[int]]:
        """Members of each leaf, in the order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack.extend(node[1][k] for k in sorted(node[1], reverse=True))


def _quicksort(words: np.ndarray, starts: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Multikey quicksort of all groups at once over the first `depth` eight-byte characters; changes `order` and `group`
    and returns the places of groups that agree in all of them."""
    n = len(order)
    at = np.zeros(n, np.int64)  # character that a group is compared by, at its first place
    open_ = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    deep = []
    while len(open_):
        own = group[open_]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[first, len(open_)])
        which = np.repeat(np.arange(len(first)), size)
        begin = own[first]
        chars = words[starts[order[open_]] + 8 * at[own]]
        three = np.sort([chars[first], chars[first + size // 2], chars[first + size - 1]], axis=0)
        pivot = three[1][which]
        less, more = chars < pivot, chars > pivot
        same = ~(less | more)
        counts = [np.add.reduceat(m, first, dtype=np.int64) for m in (less, same, more)]
        base = [begin, begin + counts[0], begin + counts[0] + counts[1]]
        to, new = np.empty(len(open_), np.int64), np.empty(len(open_), np.int64)
        for mask, count, lowest in zip((less, same, more), counts, base, strict=True):
            rank = np.cumsum(mask)
            before = np.cumsum(count) - count
            to[mask] = (rank - 1 - before[which] + lowest[which])[mask]
            new[mask] = lowest[which][mask]
        members = order[open_]
        next_at = at[own]
        order[to], group[to] = members, new
        # Depth stays with the smaller and larger ones; equal ones go on to the next character.
        at[base[0][counts[0] > 0]] = next_at[first][counts[0] > 0]
        at[base[2][counts[2] > 0]] = next_at[first][counts[2] > 0]
        equal = counts[1] > 0
        at[base[1][equal]] = next_at[first][equal] + 1
        alone = np.zeros(len(open_), bool)
        for mask, count in zip((less, same, more), counts, strict=True):
            alone |= mask & (count[which] == 1)
        done = same & ~alone & (next_at + 1 >= depth)
        deep.append(to[done])
        open_ = np.sort(to[~alone & ~done])
    return np.sort(np.concatenate(deep)) if deep else np.zeros(0, np.int64)


def sort_suffixes(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `starts` by their first `depth` bytes, and for each place of it the place where its class
    of equal ones begins. `data` goes on for `depth` bytes from each start."""
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    shallow = min(SHALLOW, depth // 8 * 8)
    if n < 2:
        return order, group
    rest = _quicksort(_words(data, big=True), starts, order, group, shallow // 8) if shallow else np.arange(n)
    raw, edges = data.tobytes(), np.flatnonzero(np.r_[True, np.diff(group[rest]) != 0]) if len(rest) else []
    for a, b in zip(edges, np.r_[edges[1:], len(rest)].tolist() if len(rest) else [], strict=True):
        trie, place = BlindTrie(), int(rest[a])
        members = order[place : place + b - a].tolist()
        for member, start in zip(members, starts[members].tolist(), strict=True):
            trie.insert(raw[start + shallow : start + depth], member)
        for own in trie.classes():
            order[place : place + len(own)] = own
            group[place : place + len(own)] = place
            place += len(own)
    return order, group


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each stretch in a row, and where each begins."""
    first = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - first, sizes) + np.arange(int(sizes.sum()))], first


def _slices(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive members of about `limit` bytes together; a larger one is alone."""
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, side="right")))
        yield slice(a, b)
        a = b


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    own = _slices(sizes, SLICE)
    return all(np.array_equal(_gather(data, a[k], sizes[k])[0], _gather(data, b[k], sizes[k])[0]) for k in own)


def _digests(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each stretch."""
    out = np.empty(len(starts), np.uint64)
    for k in _slices(sizes, SLICE):
        body, first = _gather(data, starts[k], sizes[k])
        out[k] = Hashes(body)(first, sizes[k])
    return out


def distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each class of equal stretches, and the class of each."""
    _, first, inverse = np.unique(digests, return_index=True, return_inverse=True)
    head = first[inverse]
    other = np.flatnonzero(head != np.arange(len(starts)))
    if np.array_equal(sizes[head[other]], sizes[other]) and _equal(data, starts[head[other]], starts[other], sizes[other]):
        return first, inverse
    # Two unlike stretches have one hash: go by the bytes themselves.
    raw, seen = data.tobytes(), {}
    inverse = np.array([seen.setdefault(raw[s : s + n], len(seen)) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
    return np.unique(inverse, return_index=True)[1], inverse


def _runs(data: np.ndarray, sizes: np.ndarray, names: np.ndarray, of: np.ndarray, low: np.ndarray, length: int):
    """Smallest document of every window of the distinct segments among those given: per given segment its class, and per
    class its first window, number of windows, and the windows' owners. `of` and `low`: segment and document of each place."""
    starts = np.cumsum(sizes) - sizes
    heads, classes = distinct(data, starts, sizes, _digests(data, starts, sizes))
    least = np.full(len(heads), LAST)
    np.minimum.at(least, classes[of], low)
    windows = sizes[heads] - length + 1
    first = np.cumsum(windows) - windows
    owner = np.repeat(least, windows)
    _, name_of, members = np.unique(names[heads], return_inverse=True, return_counts=True)
    # The windows of a name with a single segment are met nowhere else.
    many = np.flatnonzero(members[name_of] > 1)
    many = many[np.argsort(name_of[many], kind="stable")]
    total = np.cumsum(windows[many])
    a = 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SORTED, side="right")))
        while b < len(many) and name_of[many[b]] == name_of[many[b - 1]]:
            b += 1
        own = many[a:b]
        count = windows[own]
        shift = np.cumsum(count) - count
        inside = np.arange(int(count.sum())) - np.repeat(shift, count)
        at = np.repeat(first[own], count) + inside
        some, begin = _gather(data, starts[heads[own]], sizes[heads[own]])
        order, group = sort_suffixes(some, np.repeat(begin, count) + inside, length)
        head = np.flatnonzero(np.r_[True, np.diff(group) != 0])
        smallest = np.minimum.reduceat(owner[at][order], head)
        owner[at[order]] = np.repeat(smallest, np.diff(np.r_[head, len(order)]))
        a = b
    return classes, first, windows, owner


class Batch:
    """Documents of one batch, as the bytes of an Arrow stream; equal batches give equal segments whenever they are read."""

    def __init__(self, rows: bytes, id_col: str, text_col: str, length: int) -> None:
        self.rows = pa.ipc.open_stream(rows).read_all().combine_chunks()
        self.texts = [(t or "").encode() for t in self.rows[text_col].to_pylist()]
        self.lows = self.rows[id_col].cast(pa.int64()).fill_null(LAST).to_numpy()
        self.length = length

    def cut(self) -> None:
        """Segments of all texts: text, start among all bytes, number of windows, name."""
        lap, pieces = self.length - 1, []
        for k, text in enumerate(self.texts):
            pieces += [(k, a, min(len(text), a + SLICE + lap) - a) for a in range(0, max(0, len(text) - lap), SLICE)]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.offsets = np.cumsum(sizes) - sizes
        found = []
        for own in _slices(np.array([p[2] for p in pieces], np.int64), SLICE):
            some = pieces[own]
            _, of, starts, counts, names, first = segments([self.texts[k][a : a + n] for k, a, n in some], self.length)
            text = np.array([p[0] for p in some])[of]
            at = np.array([p[1] for p in some])[of]
            found.append((text, starts - first[of] + at + self.offsets[text], counts, names))
        none = np.zeros(0, np.int64)
        columns = zip(*found, strict=True) if found else [[none], [none], [none], [none.astype(np.uint64)]]
        self.of, self.starts, self.counts, self.names = (np.concatenate(c) for c in columns)

    def named(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names, how many segments have each, whether two documents do, and the name of each segment."""
        order = np.argsort(self.names, kind="stable")
        names, lows = self.names[order], self.lows[self.of[order]]
        new = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
        count = np.diff(np.r_[new, len(names)])
        inverse = np.empty(len(names), np.int64)
        inverse[order] = np.repeat(np.arange(len(new)), count)
        if not len(new):
            return names, count, np.zeros(0, bool), inverse
        return names[new], count, np.minimum.reduceat(lows, new) < np.maximum.reduceat(lows, new), inverse


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Rows that travel back from Python at once.
ROWS_BACK = 128


def _short(table: pa.Table) -> pa.Table:
    """The same rows in short batches, which are held outside the heap one at a time."""
    return pa.Table.from_batches(table.combine_chunks().to_batches(max_chunksize=ROWS_BACK), table.schema)


def _table(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({n: pa.array(columns[n], kinds[t]) for n, t in (c.split() for c in schema.split(", "))})


def _packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, behind their number."""
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), kind)


def _joined(blobs: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([_unpacked(b, kind) for b in blobs.to_pylist()] or [np.zeros(0, kind)])


def _split(of: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of each bucket that has any, in order."""
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(1, buckets + 1)).tolist()
    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        if b > a:
            yield k, order[a:b]


NAMES = "bucket int, batch long, names binary, counts binary, twice binary"
FLAGS = "batch long, bucket int, flags binary"
PARTS = "bucket int, batch long, sizes binary, names binary, body binary, of binary, low binary, row binary, start binary"
SPANS = "batch long, row binary, a binary, b binary"


def _send_names(batch: int, own: Batch, buckets: int) -> pa.Table:
    own.cut()
    names, counts, twice, _ = own.named()
    out = {c.split()[0]: [] for c in NAMES.split(", ")}
    for k, at in _split(_bucket(names, buckets), buckets):
        out["bucket"].append(k)
        out["batch"].append(batch)
        out["names"].append(np.ascontiguousarray(names[at].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]).tobytes())
        out["counts"].append(np.minimum(counts[at], 0xFFFF).astype("<u2").tobytes())
        out["twice"].append(np.packbits(twice[at]).tobytes())
    return _table(out, NAMES)


def _answer_names(rows: pa.Table) -> pa.Table:
    """Two bits per name that a batch sent: shared, crowded."""
    blobs = [np.frombuffer(b, np.uint8).reshape(-1, NAME_BYTES) for b in rows["names"].to_pylist()]
    sizes = [len(b) for b in blobs]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :NAME_BYTES] = np.concatenate(blobs)
    counts = np.concatenate([np.frombuffer(b, "<u2") for b in rows["counts"].to_pylist()]).astype(np.int64)
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["twice"].to_pylist(), sizes, strict=True)])
    _, inverse, batches = np.unique(wide.view(">u8").ravel(), return_inverse=True, return_counts=True)
    shared = (batches > 1) | (np.bincount(inverse, twice, len(batches)) > 0)
    crowded = np.bincount(inverse, counts, len(batches)) > CROWDED
    bits = np.stack([shared[inverse], (shared & crowded)[inverse]])
    ends = np.cumsum(sizes).tolist()
    flags = [np.packbits(bits[:, a:b].ravel()).tobytes() for a, b in zip([0, *ends], ends, strict=False)]
    return _table({"batch": rows["batch"].to_pylist(), "bucket": rows["bucket"].to_pylist(), "flags": flags}, FLAGS)


def _send_parts(batch: int, own: Batch, flags: dict[int, bytes], buckets: int) -> pa.Table:
    own.cut()
    names, _, _, inverse = own.named()
    shared, crowded = np.zeros(len(names), bool), np.zeros(len(names), bool)
    for k, at in _split(_bucket(names, buckets), buckets):
        bits = np.unpackbits(np.frombuffer(flags[k], np.uint8), count=2 * len(at)).reshape(2, -1)
        shared[at], crowded[at] = bits[0], bits[1]
    shared, crowded = shared[inverse], crowded[inverse]
    whole, apart = np.flatnonzero(shared & ~crowded), np.flatnonzero(crowded)
    count = own.counts[apart]
    shift = np.cumsum(count) - count
    inside = np.arange(int(count.sum())) - np.repeat(shift, count)
    # Segments of shared names, then the windows of crowded ones.
    starts = np.r_[own.starts[whole], np.repeat(own.starts[apart], count) + inside]
    sizes = np.r_[own.counts[whole] + own.length - 1, np.full(len(inside), own.length)]
    of = np.r_[own.of[whole], np.repeat(own.of[apart], count)]
    if not len(starts):
        return _table({c.split()[0]: [] for c in PARTS.split(", ")}, PARTS)
    digests = _digests(own.data, starts, sizes)
    heads, classes = distinct(own.data, starts, sizes, digests)
    keys = digests[heads].copy()
    is_whole = heads < len(whole)
    keys[is_whole] = own.names[whole[heads[is_whole]]]
    # Places by class, so that those of a class are a stretch.
    by = np.argsort(classes, kind="stable")
    ends = np.cumsum(np.bincount(classes, minlength=len(heads)))
    out = {c.split()[0]: [] for c in PARTS.split(", ")}
    for k, at in _split(_bucket(keys, buckets), buckets):
        size = sizes[heads[at]]
        n = np.diff(np.r_[0, ends])[at]
        places = by[np.repeat(ends[at] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        out["bucket"].append(k)
        out["batch"].append(batch)
        columns = {
            "sizes": size.astype("<u4"),
            "names": (keys[at] & np.uint64(0xFFFFFFFF)).astype("<u4"),
            "body": _gather(own.data, starts[heads[at]], size)[0],
            "of": n.astype("<u4"),
            "low": own.lows[of[places]].astype("<i8"),
            "row": of[places].astype("<u4"),
            "start": (starts[places] - own.offsets[of[places]]).astype("<u8"),
        }
        for name, values in columns.items():
            out[name].append(_packed(values))
    return _table(out, PARTS)


def _answer_parts(rows: pa.Table, length: int) -> pa.Table:
    """Spans of documents, as row of the batch, begin and end, that a smaller document's windows cover."""

    def joined(name: str, kind: str) -> np.ndarray:
        return _joined(rows[name], kind).astype(np.int64)

    sizes, names, n = joined("sizes", "<u4"), joined("names", "<u4"), joined("of", "<u4")
    low, row, start = joined("low", "<i8"), joined("row", "<u4"), joined("start", "<u8")
    of = np.repeat(np.arange(len(n)), n)
    classes, first, windows, owner = _runs(_joined(rows["body"], "u1"), sizes, names, of, low, length)
    own = classes[of]
    # Only places whose document isn't the smallest for every window; their windows that are owned below them.
    worth = np.flatnonzero(np.minimum.reduceat(owner, first)[own] < low) if len(first) else np.zeros(0, np.int64)
    batch_of = np.repeat(np.arange(rows.num_rows), [int.from_bytes(b[:8], "little") // 4 for b in rows["row"].to_pylist()])
    spans: list[tuple] = []
    for a in range(0, len(worth), PLACES):
        some = worth[a : a + PLACES]
        count = windows[own[some]]
        shift = np.cumsum(count) - count
        inside = np.arange(int(count.sum())) - np.repeat(shift, count)
        hit = owner[np.repeat(first[own[some]], count) + inside] < np.repeat(low[some], count)
        edge = np.diff(np.r_[False, hit, False].astype(np.int8))
        # A run of hits ends with its place.
        fresh = np.r_[np.isin(np.arange(len(hit)), shift), True]
        begin = np.flatnonzero(((edge == 1) | fresh)[:-1] & hit)
        end = np.flatnonzero(np.r_[hit, False][:-1] & ((edge[1:] == -1) | fresh[1:])) + 1
        place = np.repeat(np.arange(len(some)), count)[begin]
        where = start[some][place]
        spans.append((batch_of[some[place]], row[some[place]], where + inside[begin], where + inside[end - 1] + length))
    if not spans:
        return _table({c.split()[0]: [] for c in SPANS.split(", ")}, SPANS)
    which, row, a, b = (np.concatenate(c) for c in zip(*spans, strict=True))
    batches, out = rows["batch"].to_pylist(), {c.split()[0]: [] for c in SPANS.split(", ")}
    for k, at in _split(which, rows.num_rows):
        at = at[np.lexsort((a[at], row[at]))]
        out["batch"].append(batches[k])
        out["row"].append(_packed(row[at].astype("<u4")))
        out["a"].append(_packed(a[at].astype("<u8")))
        out["b"].append(_packed(b[at].astype("<u8")))
    return _table(out, SPANS)


def _remove(own: Batch, spans: pa.Table, columns: list[str]) -> tuple[list, list[bytes]]:
    """The batch's rows with what is left of their texts."""

    row, a, b = (_joined(spans[name], kind).astype(np.int64) for name, kind in (("row", "<u4"), ("a", "<u8"), ("b", "<u8")))
    of = {k: at for k, at in _split(row, len(own.texts))}
    numbers, kept = [], []
    for k, raw in enumerate(own.texts):
        at = of.get(k)
        if at is None:
            numbers.append((len(raw), 0, 0))
            kept.append(raw)
            continue
        gone = np.zeros(len(raw) + 1, np.int64)
        np.add.at(gone, a[at], 1)
        np.add.at(gone, b[at], -1)
        gone = np.cumsum(gone)[:-1] > 0
        edges = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
        numbers.append((len(raw), int(gone.sum()), edges))
        kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
    columns_ = [own.rows[c] for c in columns]
    columns_ += [pa.array([x[j] for x in numbers], pa.int64()) for j in range(3)]
    return columns_, kept


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, `kept` (the remaining bytes) and `kept_text` (these as text without broken
    characters; null where the text is)."""
    plain = docs.drop(*ADDED)
    columns = plain.columns
    total = plain.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    size = max(BATCH_BYTES, int((PER_BLOB * total) ** 0.5))
    buckets = max(1, -(-total * BUCKETS_PER_BATCH // size))

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, bytes_ = TaskContext.get().partitionId(), 0, [], 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def close() -> pa.RecordBatch:
            nonlocal n
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table)
            n += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n - 1]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names=columns)
            sizes = np.array([len(t or "") for t in batch.column(columns.index(text_col)).to_pylist()])
            a = 0
            while a < len(sizes):
                room = np.searchsorted(np.cumsum(sizes[a:]), size - bytes_, side="right")
                b = min(len(sizes), a + max(int(room), 0 if held else 1))
                if b > a:
                    held.append(batch.slice(a, b - a))
                    bytes_ += int(sizes[a:b].sum())
                if b < len(sizes) or bytes_ >= size:
                    yield close()
                    bytes_ = 0
                a = b
        if held:
            yield close()
        release()

    def each(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own = Batch(batch.column(1)[k].as_py(), id_col, text_col, length)
                    found = _short(work(batch.column(0)[k].as_py(), own))
                    del own
                    release()
                    yield from found.to_batches()

        return run

    stored_batches = stored(plain.mapInArrow(batched, "batch long, rows binary"), "suffix-batches")
    sent = stored_batches.mapInArrow(each(lambda batch, own: _send_names(batch, own, buckets)), NAMES)
    flags = sent.groupBy("bucket").applyInArrow(_answer_names, FLAGS)

    def parts(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Batch(left["rows"][0].as_py(), id_col, text_col, length)
        answers = dict(zip(right["bucket"].to_pylist(), right["flags"].to_pylist(), strict=True))
        found = _send_parts(left["batch"][0].as_py(), own, answers, buckets)
        del own
        release()
        return _short(found)

    def answered(rows: pa.Table) -> pa.Table:
        found = _answer_parts(rows, length)
        release()
        return _short(found)

    asked = stored_batches.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(parts, PARTS)
    spans = asked.groupBy("bucket").applyInArrow(answered, SPANS)
    names = [*columns, *ADDED]
    fields = [T.StructField(c, T.LongType()) for c in ADDED[:3]]
    fields += [T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Batch(left["rows"][0].as_py(), id_col, text_col, length)
        done, kept = _remove(own, right, columns)
        texts = [None if t is None else k.decode("utf-8", "ignore") for t, k in zip(own.rows[text_col].to_pylist(), kept, strict=True)]
        return _short(pa.table([*done, pa.array(kept, pa.binary()), pa.array(texts, pa.string())], names))

    schema = T.StructType([*plain.schema.fields, *fields])
    return stored_batches.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(cut, schema)
