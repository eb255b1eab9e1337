"""Target-distribution importance resampling: hashed word windows, gains of a target over the corpus, and a drawn sample.

An untrained regex Split of the tokenizers library takes the words of ASCII-lowered whole texts, with their offsets; it is
asked once for each distinct piece between spaces, as no word reaches over one. Runs of
1 to `ngram` consecutive words, joined by one space, are the features; a feature falls in the bucket of its CRC-32, which is
carried on from a window to the next longer one, a byte of all windows at a time. Each document's buckets are stored once.
Counting them gives the corpus histogram, and with the target's the gain of each bucket (a table of fixed length, which
is all that reaches the driver). A document's weight is the floored mean of its features' gains; a Gumbel draw from a
hash of its id is added, and the highest scores are drawn.

Null texts have no words; texts without words have weight 0 and are never drawn. Very long texts are split alone. Rows that
share an id are documents of their own with the same draw; equal scores are taken by the smaller id, null ids last. An
empty table gives no rows; an empty target gives gains of the corpus alone. Other columns don't matter, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladefreq.llm.common import numbered, stored

#: Words: runs without ASCII control characters, white space, punctuation, or upper case, which lowering has removed.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts split together have about so many characters; a longer one is alone.
GROUP_CHARS = 1 << 21
#: Bytes of a word that are hashed together with those of other words; longer words are hashed by themselves.
SHORT = 64
#: Distinct pieces whose words are kept per worker; beyond it the table starts anew, which costs time, never results.
KEPT = 400_000
#: Reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
ALL_ONES = np.uint32(0xFFFFFFFF)


@lru_cache(1)
def _table() -> np.ndarray:
    """State that each byte leaves behind."""
    states = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        states = (states >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (states & np.uint32(1)))
    return states


@lru_cache(1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def extend(states: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after `sizes` more bytes of `data` from `starts` on."""
    table, out = _table(), states.copy()
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -SHORT, side="left") :]
    now, at = out[order], starts[order]
    live = np.searchsorted(-sizes[order], -np.arange(SHORT + 1), side="left")
    for k in range(SHORT):
        n = live[k]
        if not n:
            break
        now[:n] = table[(now[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    out[order] = now
    for i in np.flatnonzero(sizes > SHORT).tolist():
        body = data[starts[i] : starts[i] + sizes[i]].tobytes()
        out[i] = zlib.crc32(body, int(states[i] ^ ALL_ONES)) ^ 0xFFFFFFFF
    return out


class Splitter:
    """Words of texts with their offsets. No word has a space or line feed in it, so what stands between those is split by
    itself; it repeats, and the library sees each distinct piece once per worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _learn(self, pieces: list[bytes]) -> None:
        raw = b"\n".join(pieces)
        found = np.array([o for _, o in _splitter().pre_tokenize_str(raw.decode())], np.int64).reshape(-1, 2)
        data = np.frombuffer(raw, np.uint8)
        # Offsets count characters; a character begins where a byte isn't a continuation.
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        edges = np.cumsum([len(x) + 1 for x in pieces])
        spans = begins[found]
        of = np.searchsorted(edges, spans[:, 0], side="right")
        own = (spans - (edges[of] - [len(pieces[k]) + 1 for k in of.tolist()])[:, None]).ravel().tolist()
        ends = np.cumsum(np.bincount(of, minlength=len(pieces)) * 2).tolist()
        for piece, x, y in zip(pieces, [0, *ends], ends, strict=False):
            self.known[piece] = tuple(own[x:y])

    def __call__(self, data: bytes) -> np.ndarray:
        """Begin and end of each word among the bytes, which have spaces where they had line feeds."""
        pieces = data.split(b" ")
        distinct = list(set(pieces))
        missing = [x for x in distinct if x not in self.known]
        if len(self.known) + len(missing) > KEPT:
            self.known.clear()
            missing = distinct
        if missing:
            self._learn(missing)
        at = {x: i for i, x in enumerate(distinct)}
        which = np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        starts = np.cumsum(sizes + 1) - sizes - 1
        spans = [self.known[x] for x in distinct]
        lengths = np.fromiter(map(len, spans), np.int64, len(spans)) // 2
        flat = np.fromiter((o for x in spans for o in x), np.int64, int(lengths.sum()) * 2).reshape(-1, 2)
        first = np.cumsum(lengths) - lengths
        n = lengths[which]
        shift = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(shift, n)
        return flat[np.repeat(first[which], n) + inside] + np.repeat(starts, n)[:, None]


@lru_cache(1)
def splitter() -> Splitter:
    return Splitter()


def features(texts: list[str], buckets: int, ngram: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words per text; and per window length the text of each window and its bucket."""
    lowered = [t.encode().lower() for t in texts]
    raw = b" ".join(lowered).replace(b"\n", b" ")
    data = np.frombuffer(raw, np.uint8)
    offsets = splitter()(raw)
    starts, ends = offsets[:, 0], offsets[:, 1]
    edges = np.cumsum([len(t) + 1 for t in lowered])
    of = np.searchsorted(edges, starts, side="right")
    counts = np.bincount(of, minlength=len(texts))
    spaced = np.append(data, np.uint8(32))
    states = extend(np.full(len(starts), ALL_ONES), data, starts, ends - starts)
    owners, found = [of], [(states ^ ALL_ONES) % np.uint32(buckets)]
    for k in range(1, ngram):
        same = of[k:] == of[: len(of) - k]
        # states[i] is that of the window of k words from i on.
        states = states[: len(same)]
        space = np.full(len(states), len(data))
        states = extend(states, spaced, space, np.ones(len(states), np.int64))
        states = extend(states, data, starts[k:], (ends - starts)[k:])
        owners.append(of[: len(same)][same])
        found.append((states[same] ^ ALL_ONES) % np.uint32(buckets))
    return counts, owners, found


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed(rows: DataFrame, buckets: int, ngram: int) -> DataFrame:
    """id, n_words, n_features and `own` (the buckets of all features) of rows (id, text)."""
    names = ["id", "n_words", "n_features", "own"]

    def out(ids: list, texts: list[str]) -> pa.RecordBatch:
        words, owners, found = features(texts, buckets, ngram)
        of, bucket = np.concatenate(owners), np.concatenate(found).astype(_kind(buckets))
        body = bucket[np.argsort(of, kind="stable")].tobytes()
        n = np.bincount(of, minlength=len(texts))
        width = np.dtype(_kind(buckets)).itemsize
        ends = (np.r_[0, np.cumsum(n)] * width).tolist()
        lists = [body[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        columns = [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(lists, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                if ids and size + len(text) > GROUP_CHARS:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(key)
                texts.append(text)
                size += len(text)
            if ids:
                yield out(ids, texts)

    return rows.mapInArrow(split, "id long, n_words long, n_features long, own binary")


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket; `buckets` numbers, each task's summed up before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column(0):
                total += np.bincount(np.frombuffer(body.as_buffer(), _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = found.select("own").mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares of each bucket in the target and in the corpus."""
    size = len(corpus)
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features and weight (the floored mean gain; 0 without features)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(2))
            sums = np.array([int(gain[np.frombuffer(b.as_buffer(), _kind(len(gain)))].sum()) for b in batch.column(3)], np.int64)
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    buckets: int = 10_000,
    ngram: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document's id, n_features, weight, score and rank; rank is null unless the document is among the `percent` of
    those with `min_words` or more that score highest."""
    corpus = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    wanted = target.select(F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = stored(hashed(corpus, buckets, ngram), "importance-features")
    gain = gains(histogram(found, buckets), histogram(hashed(wanted, buckets, ngram), buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed(found, gain).withColumn("score", F.col("weight") + draw), "importance-scores")
    enough = scored.where(F.col("n_words") >= min_words).withColumn("all", F.lit(0))
    placed = numbered(enough, "all", [F.desc("score"), F.col("id").asc_nulls_last()])
    drawn = F.col("pos") < F.call_function("div", F.col("n") * percent, F.lit(100))
    ranked = placed.withColumn("rank", F.when(drawn, F.col("pos") + 1))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).union(rest.select(*columns))
