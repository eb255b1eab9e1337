"""Token ids of whole texts through the tokenizers library, with the ids of repeated words kept in a bounded table.

A byte-level or word-level BPE encodes each match of its splitting pattern separately, so the ids of a text are those of
its matches in a row. Matches repeat, texts don't: the library sees each frequent match once per worker, others once per
call, and of byte-level files only its model does, which is what takes time with rare words. The patterns
below state the letters, digits and white space up to U+024F and the general punctuation; a text with any other
character goes to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼½¾"
SPACES = "\t-\r \x85\xa0"
#: Lower-cased texts are tested in lower case: U+0130 and capitals whose small letters lie beyond U+024F are others then.
OTHER = re.compile("[^\x00-ɏ‐-‧]")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The byte-level splitting pattern, a fixed value of the vocabulary files.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Its matches; letters come first, as no other branch can start with one.
BYTE_LEVEL = re.compile(
    f" ?[{LETTERS}]+|{ENDINGS}| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
#: Matches of the word-level pattern, in lower case, without white space.
WORD_LEVEL = re.compile(f"[{LETTERS}]+|{ENDINGS}|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
#: Distinct matches kept per worker, the first ones seen, which are the frequent ones; others are encoded where they occur.
KEPT = 250_000

#: The character that byte-level vocabulary files write for each byte: its own if it prints, else one from U+0100 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: b for b in PRINTED} | {b: 0x100 + k for k, b in enumerate(sorted({*range(256)} - {*PRINTED}))}


class Encoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str, lower: bool) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.split, self.lower = (WORD_LEVEL if lower else BYTE_LEVEL).findall, lower
        # A match is all that the byte-level step would leave of it: the library's model then takes it as it is.
        step = self.library.pre_tokenizer
        plain = isinstance(step, pre_tokenizers.ByteLevel) and step.use_regex and not step.add_prefix_space
        self.model = self.library.model if plain and not lower and self.library.normalizer is None else None
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _matches(self, words: list[str]) -> list[bytes]:
        """Ids of each of many matches: from the model alone, or as the words of one text that is already split."""
        if self.model is not None:
            tokenize, ids, ends = self.model.tokenize, [], []
            for w in words:
                ids += [t.id for t in tokenize(w.encode().decode("latin-1").translate(BYTE_CHARS))]
                ends.append(len(ids) * 4)
            blob = np.array(ids, dtype="<u4").tobytes()
            return [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        found = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        blob, places = np.array(found.ids, dtype="<u4").tobytes(), np.array(found.word_ids, dtype=np.int64)
        ends = (np.searchsorted(places, np.arange(len(words)), side="right") * 4).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        seen = [t.lower() for t in texts] if self.lower else texts
        plain = [(t.isascii() or not OTHER.search(t)) and not any(x in t for x in self.special) for t in seen]
        whole = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        lists = [self.split(t) if p else () for t, p in zip(seen, plain, strict=True)]
        get = self.known.get
        parts = [list(map(get, x)) for x in lists]
        holes = [[k for k, ids in enumerate(x) if ids is None] for x in parts]
        missing = list({x[k] for x, own in zip(lists, holes, strict=True) for k in own})
        found: dict[str, bytes] = {}
        for a in range(0, len(missing), 20_000):
            found.update(new := dict(zip(part := missing[a : a + 20_000], self._matches(part), strict=True)))
            if len(self.known) < KEPT:
                self.known.update(new)
        for x, ids, own in zip(lists, parts, holes, strict=True):
            for k in own:
                ids[k] = found[x[k]]
        return [b"".join(x) if p else next(whole) for x, p in zip(parts, plain, strict=True)]


@lru_cache(2)
def encoder(path: str, lower: bool) -> Encoder:
    """One encoder per worker and file. `lower`: the file is word-level and lower-cases its input."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, lower)
