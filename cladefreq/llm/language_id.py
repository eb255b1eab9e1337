"""Language ID: interpolated Kneser-Ney character models, one per language.

Text is lower-cased and every run of other characters than letters becomes one space. A model holds the probability of
each character after up to ORDER - 1 others, interpolated with shorter contexts by absolute discounting (Kneser-Ney:
shorter contexts count distinct predecessors, not occurrences). All languages share one sorted array of n-gram hashes per
order, with a column per language, so a character costs one binary search per order that is tried. The language with the
lowest cross-entropy per character wins. A text is rejected when even that cross-entropy is outside what held-back
training texts of the language show, in relation to its length.

The models are fitted on a bounded sample: of each language about `per_lang` whole labelled texts of at most `max_chars`
characters, those of lowest hash. Every text is predicted whole.

Null text, or text without a letter: `und`, score 0, rejected. Null lang: not learned from. With nothing to learn from
every text is `und`. Equal cross-entropies: the language that sorts first. Repeated ids are predicted row by row. An empty
table gives no rows. Extra columns stay, except that ones called lang_pred, score or rejected are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladefreq.llm.common import release

ORDER = 5
DISCOUNT = 0.75
#: Texts looked at together are cut into groups of about so many characters; a longer text is a group.
GROUP_CHARS = 1 << 18
UNKNOWN = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Code points per letter table.
POINTS = 0x110000
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(POINTS)), bool, POINTS))
    return _LETTER[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each text between two spaces (0), and where each text's first space stands."""
    lowered = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(0))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] > 0) | (points[:-1] > 0)
    # The space before a text stays; the one after an empty text is dropped with its own.
    first = np.r_[0, np.cumsum(lengths + 1)]
    keep[first] = True
    place = np.cumsum(keep) - 1
    return points[keep], place[first]


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place, from place n - 1 on."""
    out = np.full(len(points) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ points[k : len(points) - n + 1 + k].astype(np.uint64)) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Model:
    """langs; per order 1 to ORDER its sorted hashes and log probabilities (a column per language); per order 1 to
    ORDER - 1 the sorted hashes of contexts and the log weight each leaves to shorter ones; what calibration found."""

    langs: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    floor: float
    bounds: np.ndarray  # a row per language: mean, deviation between texts, deviation of a character

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (nats) of each text under each language, and the number of letters."""
        points, first = characters(texts)
        total = np.zeros((len(points), len(self.langs)), np.float32)
        start = np.zeros(len(points), bool)
        start[first] = True
        # Contexts end at the start of the text: a place knows the characters since then.
        known = np.arange(len(points)) - np.maximum.accumulate(np.where(start, np.arange(len(points)), 0))
        open_ = np.flatnonzero(known > 0)
        for n in range(ORDER, 0, -1):
            at = open_[known[open_] >= n - 1] if n > 1 else open_
            if not len(at):
                continue
            hashes = _hashes(points, n)[at - n + 1]
            found = np.minimum(np.searchsorted(self.grams[n - 1], hashes), len(self.grams[n - 1]) - 1)
            hit = self.grams[n - 1][found] == hashes
            total[at[hit]] += self.logs[n - 1][found[hit]]
            done = np.zeros(len(points), bool)
            done[at[hit]] = True
            missed = at[~hit]
            if n > 1 and len(missed):
                context = _hashes(points, n - 1)[missed - n + 1]
                spot = np.minimum(np.searchsorted(self.contexts[n - 2], context), len(self.contexts[n - 2]) - 1)
                seen = self.contexts[n - 2][spot] == context
                total[missed[seen]] += self.backoffs[n - 2][spot[seen]]
            elif len(missed):
                total[missed] += self.floor
            open_ = open_[~done[open_]]
        sums = np.add.reduceat(total, first[:-1], axis=0) if len(texts) else np.zeros((0, len(self.langs)))
        letters = np.add.reduceat((points > 0).astype(np.int64), first[:-1]) if len(texts) else np.zeros(0, np.int64)
        counted = np.maximum(np.diff(first) - 1, 1)
        return -sums.astype(np.float64) / counted[:, None], letters

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, score and whether it is rejected, of each text."""
        entropy, letters = self.entropies(texts)
        out = []
        for row, n in zip(entropy, letters.tolist(), strict=True):
            if not n:
                out.append((UNKNOWN, 0.0, True))
                continue
            best = int(row.argmin())
            mean, between, within = self.bounds[best]
            # The share of the best among all, as if at most 50 characters were independent.
            odds = np.exp(-(row - row[best]) * min(n, 50))
            strange = row[best] > mean + 8 * between + 6 * within / np.sqrt(n)
            out.append((self.langs[best], float(1 / odds.sum()), bool(strange)))
        return out


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: hashes of n-grams, their counts (distinct predecessors below the top order), and the hashes of the
    context and of the shorter n-gram of each."""
    points, first = characters(texts)
    start = np.zeros(len(points), bool)
    start[first] = True
    known = np.arange(len(points)) - np.maximum.accumulate(np.where(start, np.arange(len(points)), 0))
    grams, out = {}, []
    for n in range(1, ORDER + 1):
        ends = np.flatnonzero((known >= n - 1) & (known > 0))
        hashes, where, counts = np.unique(_hashes(points, n)[ends - n + 1], return_index=True, return_counts=True)
        grams[n] = (hashes, ends[where], counts)
    for n in range(1, ORDER + 1):
        hashes, ends, counts = grams[n]
        if n < ORDER:
            # A predecessor is a distinct (n + 1)-gram that ends in this n-gram; one that starts a text has none.
            longer = _hashes(points, n)[grams[n + 1][1] - n + 1]
            places = np.searchsorted(hashes, longer)
            counts = np.maximum(np.bincount(places, minlength=len(hashes)), 1)
        context = _hashes(points, n - 1)[ends - n + 1] if n > 1 else np.zeros(len(ends), np.uint64)
        lower = _hashes(points, n - 1)[ends - n + 2] if n > 1 else np.zeros(len(ends), np.uint64)
        out.append((hashes, counts, context, lower))
    return out


def fit(samples: dict[str, list[str]]) -> Model | None:
    """Models of the given texts by language; a tenth of them, five at least, is held back for calibration."""
    langs = sorted(k for k, v in samples.items() if any(_letters()[[ord(c) for c in t]].any() for t in v if t))
    if not langs:
        return None
    held = {k: samples[k][:: max(2, min(10, len(samples[k]) // 5 or 2))] if len(samples[k]) > 1 else samples[k] for k in langs}
    train = {}
    for k in langs:
        back = set(held[k])
        train[k] = [t for t in samples[k] if len(samples[k]) == 1 or t not in back] or samples[k]
    counted = {k: _counts(train[k]) for k in langs}
    union = [np.unique(np.concatenate([counted[k][n][0] for k in langs])) for n in range(ORDER)]
    floor = float(np.log(1e-6))
    logs, contexts, backoffs = [], [], []
    context_of: list[np.ndarray] = []
    lower_of: list[np.ndarray] = []
    for n in range(ORDER):
        ctx, low = np.zeros(len(union[n]), np.uint64), np.zeros(len(union[n]), np.uint64)
        for k in langs:
            at = np.searchsorted(union[n], counted[k][n][0])
            ctx[at], low[at] = counted[k][n][2], counted[k][n][3]
        context_of.append(ctx)
        lower_of.append(low)
    for n in range(ORDER):
        keys = np.unique(context_of[n])
        slot = np.searchsorted(keys, context_of[n])
        prob = np.zeros((len(union[n]), len(langs)))
        left = np.zeros((len(keys), len(langs)))
        for j, k in enumerate(langs):
            hashes, counts, _, _ = counted[k][n]
            own = np.zeros(len(union[n]))
            own[np.searchsorted(union[n], hashes)] = counts
            total = np.bincount(slot, own, len(keys))
            kinds = np.bincount(slot, own > 0, len(keys))
            rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            direct = np.maximum(own - DISCOUNT, 0) / np.maximum(total, 1)[slot]
            if n:
                shorter = np.exp(logs[n - 1][np.searchsorted(union[n - 1], lower_of[n]), j])
            else:
                shorter = np.full(len(union[0]), 1 / (len(union[0]) + 1))
            prob[:, j] = direct + rest[slot] * shorter
            left[:, j] = np.log(rest)
        logs.append(np.log(np.maximum(prob, 1e-6)).astype(np.float32))
        if n:
            contexts.append(keys)
            backoffs.append(left.astype(np.float32))
    model = Model(langs, union, logs, contexts, backoffs, floor, np.zeros((len(langs), 3)))
    for j, k in enumerate(langs):
        entropy, letters = model.entropies(held[k])
        own, size = entropy[letters > 0, j], letters[letters > 0]
        if not len(own):
            own, size = np.array([3.0]), np.array([1])
        weight = size / size.sum()
        mean = float((weight * own).sum())
        between = max(0.1, float(np.sqrt((weight * (own - mean) ** 2).sum())))
        model.bounds[j] = mean, between, max(1.0, float(np.sqrt((size * (own - mean) ** 2).mean())))
    return model


def sample(
    docs: DataFrame, usable: Column, per_lang: int, max_chars: int, id_col: str, text_col: str, lang_col: str
) -> dict[str, list[str]]:
    """Texts by language: at most `per_lang` of each, those whose ids have the lowest hash."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("hash"), F.col(text_col).alias("text")
    )
    counted = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counted:
        return {}
    # The lowest hashes lie below this share of their range, with room for chance; the rest is cut here.
    share = [F.when(F.col("lang") == k, F.lit(min(1.0, (per_lang * 1.2 + 50) / n))) for k, n in counted.items()]
    below = (F.col("hash").cast("double") / F.lit(2.0**64) + 0.5) < F.coalesce(*share)
    found = defaultdict(list)
    for r in rows.where(below & (F.length("text") <= max_chars)).collect():
        found[r["lang"]].append((r["hash"], r["text"]))
    return {k: [t for _, t in sorted(v)[:per_lang]] for k, v in found.items()}


def identify(
    docs: DataFrame,
    usable: Column,
    per_lang: int = 400,
    max_chars: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and rejected. Learns from rows where `usable` holds and lang is not null."""
    model = fit(sample(docs, usable, per_lang, max_chars, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("lang_pred", "score", "rejected")
    names = [*rows.columns, "lang_pred", "score", "rejected"]
    at = rows.columns.index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, out, k = [t or "" for t in batch.column(at).to_pylist()], [], 0
            while k < len(texts):
                end, held = k, 0
                while end < len(texts) and (end == k or held + len(texts[end]) <= GROUP_CHARS):
                    held += len(texts[end])
                    end += 1
                out += own.predict(texts[k:end]) if own else [(UNKNOWN, 0.0, True)] * (end - k)
                k = end
            more = [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)
        release()

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *more, T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(predicted, schema)
