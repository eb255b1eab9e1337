"""Token operators against the libraries, over all letters up to U+024F, special tokens, nulls, ties and long texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from cladefreq.llm import bpe, packing, pieces, simple8b, token_files

LOW = [chr(c) for c in range(0x250)]
HIGH = [chr(c) for c in range(0x2010, 0x2028)] + list("漢字é́ΑΣςא🙂‍　ﬁ")


def random_texts(n, seed):
    draw = random.Random(seed)
    words = ["Hello", "it's", "İstanbul", "Əliyev", "Ɓamako", "don't", "x1y2", "  ", "\n", "'ll", "'LL", "ǅ", "ß", "ẞ"]
    texts = []
    for k in range(n):
        pool = LOW if k % 3 else LOW + HIGH
        parts = [draw.choice(words) if draw.random() < 0.3 else "".join(draw.choice(pool) for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 14))]
        texts.append(draw.choice([" ", ""]).join(parts))
    return texts + ["", " ", "<|endoftext|>", "a<|endoftext|>b", "<|STARTOFTEXT|> x", "x" * 5000, *LOW]


@pytest.mark.parametrize(("name", "lower"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_the_library_s(name, lower):
    path = public_tokenizers.path(name)
    texts = random_texts(3000, 1)
    wanted = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    found = [np.frombuffer(b, "<u4").tolist() for b in pieces.Encoder(path, lower)(texts)]
    assert [t for t, a, b in zip(texts, found, wanted, strict=True) if a != b] == []


def test_rare_matches_go_to_the_model_alone(monkeypatch):
    """With few matches kept; the library's splitting of texts, several times as slow, isn't run for a match."""
    monkeypatch.setattr(pieces, "KEPT", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for t in random_texts(1500, 3) if not pieces.OTHER.search(t) and "<|" not in t] + ["".join(LOW), "\0\0 a\0"]
    wanted = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    own = pieces.Encoder(path, False)
    own.library = None
    own._whole = lambda _: []
    for _ in range(2):
        found = [np.frombuffer(b, "<u4").tolist() for k in range(0, len(texts), 100) for b in own(texts[k : k + 100])]
        assert found == wanted
    assert len(own.known) < 2000


def test_bpe_is_the_library_s():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = random_texts(2000, 2)
    for pattern in (public_tokenizers.PATTERN, r"\S+|\s+", r"(\w)+|\W"):
        known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
        own = bpe.Bpe(bpe.load_ranks(path), pattern)
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text), repr(text)
            assert own.decode(ids) == text.encode()


def test_positions_beyond_24_bits():
    """A leaf holds its rank above forty bits of position."""
    own = bpe.bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    a, b = own.ranks[b"t"], own.ranks[b"h"]
    at = (1 << 30) + 5
    leaf = int(own._rank(np.array([a]), np.array([b]), np.array([at]))[0])
    assert leaf >> bpe.PLACE == own.ranks[b"th"] and leaf & ((1 << bpe.PLACE) - 1) == at
    with pytest.raises(ValueError):
        bpe.Bpe({bytes([k]): k for k in range(255)} | {b"\xff": 1 << 22}, "x")


DOCS = [(3, "Hello world, it's me " * 40, 1), (1, None, 1), (None, "no id", 1), (2, "", 1), (2, "tie b", 1), (2, "tie a", 1), (5, "漢字 " * 3000, 1),
        (-4, "Ƀ Əliyev", 1), (7, "same", 1), (7, "same", 1)]


def test_documents_through_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    frame = spark.createDataFrame(DOCS, "doc_id long, text string, ids int").repartition(3)
    got = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in bpe.encode_documents(frame, path, public_tokenizers.PATTERN).collect()), key=str)
    assert got == sorted(((k, known.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in DOCS), key=str)
    assert bpe.encode_documents(frame.where("false"), path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("range_rows", [4096, 2])
def test_token_files_round_trip(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(token_files, "RANGE_ROWS", range_rows)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    frame = spark.createDataFrame(DOCS, "doc_id long, text string, part int").repartition(3)
    folder = str(tmp_path / "files")
    token_files.write_token_files(frame, folder, path, end_id=0)
    got = sorted(((r.id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read_token_files(spark, folder).collect()), key=lambda r: r[1])
    rows = [(k, library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t, _ in DOCS]
    assert [k for k, *_ in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    at = 0
    for key, start, n, ids in got:
        assert start == at and n == len(ids)
        rows.remove((key, ids))
        at += n
    assert rows == []


def test_token_files_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(frame, str(tmp_path / "none"), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_pieces_hold_the_library_s_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = [(k, t) for k, t in enumerate(random_texts(300, 5)[:300] + ["Əliyev word " * 4000])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {}
    for r in packing.pack(frame, path, end_id=2, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        found.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for key, text in docs:
        wanted = library.encode(text, add_special_tokens=False).ids + [2]
        parts = sorted(found[key])
        assert [x for _, ids, _ in parts for x in ids] == wanted
        assert {n for _, _, n in parts} == {len(wanted)}


@pytest.mark.parametrize("top", [1, 70_000, (1 << 64) - 1])
def test_lists_coded_side_by_side(top):
    draw = np.random.default_rng(top % 97)
    for _ in range(30):
        sizes = draw.choice([0, 1, 2, 60, 127, 128, 129, 500], draw.integers(0, 7))
        values = draw.integers(0, top, int(sizes.sum()), dtype=np.uint64, endpoint=True)
        coded = simple8b.encode_each(values, sizes)
        assert simple8b.decode_each(b"".join(coded), np.cumsum([len(c) for c in coded])).tolist() == values.tolist()
        one = simple8b.encode(values)
        blocks = [simple8b.decode_block(one, k).tolist() for k in range(-(-len(values) // simple8b.BLOCK))]
        assert [x for b in blocks for x in b] == values.tolist()
