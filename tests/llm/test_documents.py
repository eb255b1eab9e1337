"""Document operators against plain versions: repeats, near copies, packing, coding, tokens, languages, the pipeline."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cladefreq.llm import bagminhash, bpe, language_id, near_dedup, packing, simple8b, suffix_dedup

SCHEMA = "doc_id long, text string, kept string"


def repeats(docs, length):
    """doc_id to (bytes, removed, spans, digest) by looking at every window of every document."""
    first = {}
    for key, text in sorted(docs):
        raw = text.encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], key)
    out = []
    for key, text in docs:
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < key:
                gone[i : i + length] = b"\1" * length
        spans = len([1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])])
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((key, len(raw), sum(gone), spans, left))
    return sorted(out)


def texts_with_passages(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 8)))
    passage = " ".join(word() for _ in range(30))
    docs = []
    for i in range(40):
        body = " ".join(word() for _ in range(draw.randint(0, 120)))
        if i % 3 == 0:
            cut = draw.randint(0, 40)
            body += passage[cut:] + body[:60]
        docs.append((i, body))
    docs += [(40, docs[5][1]), (41, "ab" * 200), (42, "x" + "ab" * 150), (43, ""), (44, passage[:50]), (3, "again " + passage)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_every_window(spark, seed):
    docs = texts_with_passages(seed)
    frame = spark.createDataFrame([(k, t, "z") for k, t in docs], SCHEMA).repartition(5)
    found = suffix_dedup.remove_repeats(frame, 50)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())
    assert got == repeats(docs, 50)


@pytest.mark.parametrize("small", ["CROWDED", "SLICE", "SORTED", "BATCH_BYTES", "SEGMENT_WINDOWS"])
def test_repeats_whatever_the_sizes(spark, monkeypatch, small):
    """Crowded names go window by window; slices, sorts, batches and segments may be as short as they like."""
    from pyspark import cloudpickle

    monkeypatch.setattr(suffix_dedup, small, {"CROWDED": 1, "SLICE": 70, "SORTED": 3, "BATCH_BYTES": 900, "SEGMENT_WINDOWS": 2}[small])
    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        docs = texts_with_passages(3)
        frame = spark.createDataFrame([(k, t, "z") for k, t in docs], SCHEMA).repartition(4)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame, 50).collect())
        assert got == repeats(docs, 50)
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


def test_a_gram_in_thousands_of_contexts(spark, monkeypatch):
    """A phrase longer than a gram in 3,000 unlike contexts, and two of these contexts alike."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(40))
    docs = [(i, f"{word()} the common phrase of all texts {word()}") for i in range(3000)]
    docs += [(4000, "x " + docs[700][1][10:90]), (4001, docs[5][1])]
    frame = spark.createDataFrame([(k, t, "z") for k, t in docs], SCHEMA).repartition(8)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame, 50).collect())
    assert got == repeats(docs, 50)


def test_blind_trie_orders_and_joins():
    draw = random.Random(1)
    texts = [bytes(draw.choice(b"ab") for _ in range(7)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie()
    for k, t in enumerate(texts):
        trie.insert(t, k)
    found = [sorted({texts[k] for k in own}) for own in trie.classes()]
    assert found == [[t] for t in sorted(set(texts))]
    assert sorted(k for own in trie.classes() for k in own) == list(range(300))


def test_suffix_order_is_the_sorted_one():
    draw = np.random.default_rng(3)
    data = draw.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1600] = data[:600]
    starts = np.arange(len(data) - 50)
    order, group = suffix_dedup.sort_suffixes(data, starts, 50)
    cut = [data[s : s + 50].tobytes() for s in starts[order]]
    assert cut == sorted(cut)
    assert all((a == b) == (g == h) for a, b, g, h in zip(cut, cut[1:], group, group[1:], strict=False))


def test_repeats_of_nulls_and_nothing(spark):
    long = "some words that are long enough to count as one window of bytes"
    frame = spark.createDataFrame([(None, long, "a"), (1, None, "b"), (2, long, "c"), (2, long, "c"), (3, "", None)], SCHEMA)
    got = {(r.doc_id, r.text): (r.n_removed, r.kept_text) for r in suffix_dedup.remove_repeats(frame, 50).collect()}
    assert got == {(None, long): (len(long), ""), (1, None): (0, None), (2, long): (0, long), (3, ""): (0, "")}
    assert suffix_dedup.remove_repeats(frame.where("false"), 50).count() == 0


def shingle_counts(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def test_overlap_is_the_weighted_jaccard():
    a, b = "a b c d e f a b c d e f g h", "a b c d e f g h a b c d e"
    x, y = shingle_counts(a), shingle_counts(b)
    wanted = sum((x & y).values()) / sum((x | y).values())
    assert bagminhash.overlap([a, "", a], [b, "", a]).tolist() == pytest.approx([wanted, 0, 1])


def test_signatures_are_unbiased():
    draw = random.Random(5)
    sims, truth = [], []
    for _ in range(60):
        a = [str(draw.random()) for _ in range(200)]
        b = list(a)
        for i in draw.sample(range(200), 6):
            b[i] = str(draw.random())
        left, right = " ".join(a), " ".join(b)
        s = bagminhash.signatures(*bagminhash.shingles([left, right]), 2, 125)
        sims.append((s[0] == s[1]).mean())
        truth.append(bagminhash.overlap([left], [right])[0])
    assert abs(np.mean(sims) - np.mean(truth)) < 0.02


def test_near_copies_link_into_classes(spark):
    draw = random.Random(7)
    base = [" ".join(f"w{draw.randint(0, 500)}" for _ in range(120)) for _ in range(6)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(10 + i, base[i % 3] + f" tail{i}") for i in range(9)] + [(30, base[0]), (31, None), (32, ""), (33, "?!"), (34, "?!")]
    frame = spark.createDataFrame([(k, t, "z") for k, t in docs], SCHEMA)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()}
    wanted = {k: k for k, _ in docs} | {10 + i: i % 3 for i in range(9)} | {30: 0, 34: 33}
    assert got == wanted
    left = {r.doc_id for r in near_dedup.drop_near_duplicates(frame).select("doc_id", "kept").collect()}
    assert left == {k for k, v in wanted.items() if k == v}


def test_windows_are_near_equal_and_never_too_full():
    draw = random.Random(1)
    sizes = [draw.randint(1, 900) for _ in range(300)]
    found = packing.windows(sizes, 1000)
    filled = np.bincount(found, weights=sizes)
    assert filled.max() <= 1000
    assert filled.max() - filled.min() < 300
    assert packing.windows([], 10).tolist() == []


def test_pieces_hold_each_id_once(spark):
    frame = spark.createDataFrame([(1, "Hello world " * 3000, "a"), (2, None, "b"), (None, "x", "c"), (1, "y", "d")], SCHEMA)
    rows = packing.pack(frame, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=True).collect()
    assert sum(r.length for r in rows) == 6001 + 1 + 2 + 2
    sequences = {}
    for r in rows:
        assert len(r.ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("values", [[], [0], [1 << 63, 5, 0], list(range(1000)), [0] * 500 + [(1 << 60) - 1, 1 << 60]])
def test_coding_round_trip(values):
    values = np.array(values, np.uint64)
    assert simple8b.decode(simple8b.encode(values)).tolist() == values.tolist()


def test_bpe_equals_tiktoken():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = bpe.bpe(path, public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = ["", "Hello, world's end  \n\n x", "áéí 漢字 🙂 <|endoftext|>", "a" * 3000, "ab1 " * 50]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_languages_of_nulls_and_nothing(spark):
    docs = [(i, "the cat and the dog went home " * 3, "en") for i in range(30)]
    docs += [(100 + i, "der hund und die katze gehen heim " * 3, "de") for i in range(30)] + [(200, None, "en"), (201, "12 ?!", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame, F.lit(True)).collect()}
    assert got[200] == got[201] == ("und", 0.0)
    assert got[0][0] == "en" and got[100][0] == "de"
    assert {r.lang_pred for r in language_id.identify(frame, F.lit(False)).collect()} == {"und"}


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline

    words = "the river runs past old stone houses where people sell bread fish and books every morning".split()
    draw = random.Random(2)
    texts = [" ".join(draw.choice(words) for _ in range(80)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(90, texts[0], "en", "s", 1), (91, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_copies(spark, corpus_pipeline.language(spark, docs, ""), "")
    assert {r.doc_id for r in kept.collect()} == set(range(40))
    cut = corpus_pipeline.repeated_passages(spark, kept, "")
    assert cut.columns == list(corpus_pipeline.COLUMNS)
    wanted = {k: len(left.decode("utf-8", "ignore")) for k, _, _, _, left in repeats([(i, t) for i, t in enumerate(texts)], 50)}
    assert {r.doc_id: r.n_chars for r in cut.collect()} == wanted
    assert {r.doc_id for r in corpus_pipeline.packed_windows(spark, cut, "").collect()} == set(range(40))
