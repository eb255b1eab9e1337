"""BagMinHash: signatures of multisets whose registers agree with the probability of their weighted Jaccard similarity.

A multiset of shingles is a set of weights. The weight axis is cut at 0, 1, 2, 4, 8, ...; each shingle and interval has a
Poisson process of points (time, register, weight), derived from hashes alone, of a rate in proportion to the interval's
length. A point counts for a document whose weight of that shingle lies above it. Each register keeps the time of its
first point. Points are drawn by time, so a process is left as soon as its next point comes after the last register's
time: long documents draw little more than one point per shingle. All processes of a batch advance side by side.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of words: ASCII letters and digits, and everything beyond ASCII.
IN_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
PLACES = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | ONE


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number (ascending), hash and count. A shingle is WORDS lower-cased words in a
    row; a text of fewer words, but some, is one shingle; one without words has none."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1] if raw else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none.astype(np.uint64), none
    inside = IN_WORD[data]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return none, none.astype(np.uint64), none
    # The sum of byte values times BASE^place is a difference of running sums; INVERSE^start moves it to place 0.
    powers = np.full(len(data), BASE, np.uint64)
    powers[0] = ONE
    running = np.r_[np.uint64(0), np.cumsum(BYTE_VALUES[data] * np.cumprod(powers))]
    powers[1:] = INVERSE
    words = mix((running[ends] - running[starts]) * np.cumprod(powers)[starts] + (ends - starts).astype(np.uint64))
    of = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(of, minlength=len(texts))
    first = np.cumsum(counts) - counts
    last = np.repeat(first + np.maximum(counts - WORDS, 0), counts)
    begin = np.flatnonzero(np.arange(len(words)) <= last)
    end = np.repeat(first + counts, counts)[begin]
    hashes = np.zeros(len(begin), np.uint64)
    for k in range(WORDS):
        at = begin + k
        hashes += np.where(at < end, words[np.minimum(at, len(words) - 1)] * PLACES[k], np.uint64(0))
    hashes = mix(hashes)
    of = of[begin]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])])
    return of[new], hashes[new], np.diff(np.r_[new, len(of)])


def signatures(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Registers (as 64-bit patterns) of `n` multisets; those without shingles keep infinite times."""
    times = np.full(n * registers, np.inf)
    elements = []
    for k in range(int(weights.max(initial=0)).bit_length() + 1):
        low, length = (0, 1) if k == 0 else (1 << (k - 1), 1 << (k - 1))
        own = np.flatnonzero(weights > low)
        if len(own):
            seed = mix(hashes[own] + np.array([k], np.uint64) * BASE)
            elements.append((of[own], seed, (weights[own] - low) / length, np.full(len(own), 1 / (length * registers))))
    if not elements:
        return times.view(np.uint64).reshape(n, registers)
    doc, seed, share, step = (np.concatenate(x) for x in zip(*elements, strict=True))
    time, latest, draw = np.zeros(len(doc)), np.full(n, np.inf), 0
    while len(doc):
        draw += 1
        first = mix(seed + np.array([2 * draw], np.uint64) * BASE)
        second = mix(first ^ seed)
        time = time - np.log1p(-((first >> np.uint64(11)) * 2.0**-53)) * step
        near = time < latest[doc]
        doc, seed, share, step, time, second = (x[near] for x in (doc, seed, share, step, time, second))
        counts = (second >> np.uint64(32)) * 2.0**-32 < share
        register = ((second & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(times, doc[counts] * registers + register[counts], time[counts])
        # Only documents that still draw need their last register looked up; early draws seldom fill all of them.
        live = np.unique(doc)
        latest[live] = times.reshape(n, registers)[live].max(1)
    return times.view(np.uint64).reshape(n, registers)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A hash per band of `rows` registers of each signature."""
    n, registers = signature.shape
    cut = signature.reshape(n, registers // rows, rows)
    out = np.tile(np.arange(1, registers // rows + 1, dtype=np.uint64) * BASE, (n, 1))
    for k in range(rows):
        out = mix(out ^ cut[:, :, k])
    return out.view(np.int64)


def overlap(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts; 0 where neither has any."""
    n = len(left)
    of, hashes, counts = shingles([*left, *right])
    order = np.lexsort((hashes, of % n)) if n else np.zeros(0, np.int64)
    of, hashes, counts = of[order], hashes[order], counts[order].astype(np.float64)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of[1:] % n == of[:-1] % n)) if len(of) else np.zeros(0, np.int64)
    shared = np.bincount(of[same] % n, np.minimum(counts[same], counts[same + 1]), n) if n else np.zeros(0)
    total = np.bincount(of % n, counts, n) if n else np.zeros(0)
    return shared / np.maximum(total - shared, 1)
