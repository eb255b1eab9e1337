"""Simple-8b: word-aligned coding of unsigned integers, vectorised over blocks.

A 64-bit word holds a 4-bit selector and 60 bits of payload: as many values as the selector says, each in as many bits.
Selector 0 is the escape: its payload is a place in a list of plain 64-bit values. Blocks of 128 values start on a word
of their own, and their word offsets are stored, so any block can be decoded alone and all blocks side by side.

Lists of their own may be coded side by side, each in whole words: then they can be moved and decoded apart.

A coded chunk is: magic, number of values, blocks, words and escaped values (little-endian), block offsets (unsigned
32-bit), words, escaped values (unsigned 64-bit).
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
#: Values per word and bits per value, by selector; selector 0 is the escape.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120])
BITS = np.array([60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
#: A window of COUNTS[i] values is one of COUNTS[a] values, then one of COUNTS[b].
HALVES = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 9: (8, 2), 10: (8, 4), 11: (8, 7), 12: (9, 9), 13: (11, 11), 14: (13, 13), 15: (14, 14)}
HEAD = struct.Struct("<4sQIII")
MAGIC = b"S8B1"
NO_FIT = 255


#: Bit lengths of the values that token ids have.
SMALL = np.repeat(np.arange(19, dtype=np.uint8), np.r_[1, 1 << np.arange(18)])


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.max() < len(SMALL):
        return SMALL[values]
    high = values >> np.uint64(32)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low).astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place of each block, the selector that packs most values from there."""
    widest, best = {1: bits}, np.where(bits <= 60, 1, 0).astype(np.uint8)
    for code, (a, b) in HALVES.items():
        far, step = np.full_like(bits, NO_FIT), int(COUNTS[a])
        if step >= bits.shape[1]:
            break
        np.maximum(widest[a][:, :-step], widest[b][:, step:], out=far[:, :-step])
        widest[code] = far
        np.maximum(best, (far <= BITS[code]).view(np.uint8) * np.uint8(code), out=best)
    return best


def _words(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code blocks of up to BLOCK values each: words, where the values of each begin, selectors, and escaped values."""
    sizes = ends - begins
    bits = np.full((len(begins), BLOCK), NO_FIT, np.uint8)
    place = np.arange(BLOCK) < sizes[:, None]
    bits[place] = _bit_lengths(values)
    best = np.zeros(len(values), np.uint8)
    best[:] = _selectors(bits)[place]
    at, end, starts = begins, ends, []
    # The chain of words of each block, all blocks side by side.
    while len(at):
        starts.append(at)
        at = at + COUNTS[best[at]]
        live = at < end
        at, end = at[live], end[live]
    starts = np.sort(np.concatenate(starts))
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for code in np.unique(chosen):
        own = np.flatnonzero(chosen == code)
        if code == 0:
            words[own] = np.arange(len(own), dtype=np.uint64)
        elif BITS[code]:
            for j in range(COUNTS[code]):
                words[own] |= values[starts[own] + j] << np.uint64(j * BITS[code])
    return words, starts, chosen, values[starts[chosen == 0]]


def encode(values: np.ndarray) -> bytes:
    """Code unsigned integers of any size below 2^64; no values give a chunk without blocks."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return HEAD.pack(MAGIC, 0, 0, 0, 0) + np.zeros(1, "<u4").tobytes()
    begins = np.arange(blocks) * BLOCK
    words, starts, _, plain = _words(values, begins, np.minimum(begins + BLOCK, n))
    offsets = np.r_[np.searchsorted(starts, begins), len(words)]
    head = HEAD.pack(MAGIC, n, blocks, len(words), len(plain))
    return head + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes() + plain.astype("<u8").tobytes()


#: Head of a list coded side by side with others: values, blocks, words and escaped values.
SMALL_HEAD = struct.Struct("<QIII")


def encode_each(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Code lists of `sizes` values, one after the other in `values`, each into bytes of its own: head, block offsets,
    words and escaped values. All blocks of all lists are coded together."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    sizes = np.asarray(sizes, np.int64)
    blocks = -(-sizes // BLOCK)
    firsts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), blocks)
    first_block = np.cumsum(blocks) - blocks
    begins = firsts[of] + (np.arange(len(of)) - first_block[of]) * BLOCK
    ends = np.minimum(begins + BLOCK, (firsts + sizes)[of])
    if not len(values):
        return [SMALL_HEAD.pack(0, 0, 0, 0)] * len(sizes)
    words, starts, chosen, plain = _words(values, begins, ends)
    block_words = np.r_[np.searchsorted(starts, begins), len(words)]
    escaped = np.r_[0, np.cumsum(chosen == 0)]
    # An escape's payload is its place in the list's own escaped values.
    word_edges = np.r_[block_words[first_block[blocks > 0]], len(words)] if len(of) else np.zeros(1, np.int64)
    at = np.flatnonzero(chosen == 0)
    if len(at):
        words[at] -= escaped[word_edges[np.searchsorted(word_edges, at, side="right") - 1]].astype(np.uint64)
    raw, rest = words.astype("<u8").tobytes(), plain.astype("<u8").tobytes()
    tables = block_words.astype(np.int64)
    out = []
    for n, b, f in zip(sizes.tolist(), blocks.tolist(), first_block.tolist(), strict=True):
        if not n:
            out.append(SMALL_HEAD.pack(0, 0, 0, 0))
            continue
        lo, hi = int(tables[f]), int(tables[f + b])
        e_lo, e_hi = int(escaped[lo]), int(escaped[hi])
        table = (tables[f : f + b + 1] - lo).astype("<u4").tobytes()
        out.append(SMALL_HEAD.pack(n, b, hi - lo, e_hi - e_lo) + table + raw[8 * lo : 8 * hi] + rest[8 * e_lo : 8 * e_hi])
    return out


def decode_each(coded: bytes, ends: np.ndarray) -> np.ndarray:
    """All values of lists coded by `encode_each` that end at `ends` within `coded`, one after the other; the words of
    all lists are unpacked together."""
    words, plains, total, escapes, shifts, counts = [], [], 0, 0, [], []
    start = 0
    for end in np.asarray(ends).tolist():
        n, blocks, size, plain = SMALL_HEAD.unpack_from(coded, start)
        at = start + SMALL_HEAD.size + (4 * (blocks + 1) if n else 0)
        words.append(np.frombuffer(coded, "<u8", size, at))
        plains.append(np.frombuffer(coded, "<u8", plain, at + 8 * size))
        shifts.append(escapes)
        counts.append(n)
        total, escapes, start = total + n, escapes + plain, end
    if not total:
        return np.zeros(0, np.uint64)
    sizes = np.array([len(w) for w in words])
    joined, plain = np.concatenate(words), np.concatenate(plains)
    # A list's last word may have room for values beyond its end: these are left out.
    fill = COUNTS[(joined >> np.uint64(60)).astype(np.int64)]
    held = np.add.reduceat(fill, np.r_[0, np.cumsum(sizes)[:-1]][sizes > 0])
    return _unpack_each(joined, plain, np.array(counts)[sizes > 0], held, np.repeat(shifts, sizes))


def _unpack_each(words: np.ndarray, plain: np.ndarray, counts: np.ndarray, held: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    if len(plain):
        words = words.copy()
        own = (words >> np.uint64(60)) == 0
        words[own] += shifts[own].astype(np.uint64)
    out = _unpack(words, plain, int(held.sum()))
    edges = np.cumsum(held) - held
    if (held == counts).all():
        return out
    keep = np.zeros(len(out) + 1, np.int64)
    np.add.at(keep, edges, 1)
    np.add.at(keep, edges + counts, -1)
    return out[np.cumsum(keep)[:-1] > 0]


def _parts(chunk: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    magic, n, blocks, words, plain = HEAD.unpack_from(chunk)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b chunk")
    at = HEAD.size
    offsets = np.frombuffer(chunk, "<u4", blocks + 1, at)
    at += offsets.nbytes
    return n, offsets, np.frombuffer(chunk, "<u8", words, at), np.frombuffer(chunk, "<u8", plain, at + 8 * words)


def _unpack(words: np.ndarray, plain: np.ndarray, n: int) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for code in np.unique(chosen):
        own = np.flatnonzero(chosen == code)
        if code == 0:
            out[starts[own]] = plain[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif BITS[code]:
            mask = np.uint64((1 << int(BITS[code])) - 1)
            for j in range(COUNTS[code]):
                out[starts[own] + j] = (words[own] >> np.uint64(j * BITS[code])) & mask
    return out


def decode(chunk: bytes) -> np.ndarray:
    """All values of a chunk."""
    n, _, words, plain = _parts(chunk)
    return _unpack(words, plain, n)


def decode_block(chunk: bytes, block: int) -> np.ndarray:
    """The values of one block, read through its offset."""
    n, offsets, words, plain = _parts(chunk)
    return _unpack(words[offsets[block] : offsets[block + 1]], plain, min(BLOCK, n - block * BLOCK))
