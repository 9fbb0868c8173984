"""Token ids by the tokenizers library, with a cache of what single pre-tokens give.

Byte-pair merges never cross a pre-token. Texts whose characters all lie below U+0100, where letters, digits and white
space are few and known, are cut into pre-tokens by a pattern; each distinct pre-token goes through the library's model
once per worker, and the ids of a text are its pre-tokens' ids joined. Any other text goes through the whole library
tokenizer. Ids are below 65,536 and are kept as little-endian unsigned 16-bit integers.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters, digits and white space below U+0100, and the pre-token patterns of the two vocabularies.
LETTERS, DIGITS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
KEPT_SPACE = re.compile(f" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
NO_SPACE = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
#: Byte-level vocabularies write the bytes without a printable Latin-1 character as U+0100 and on, in ascending order.
HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(HIDDEN)}
#: Pre-tokens kept by a worker; beyond that the cache starts anew.
MOST_KEPT = 1_000_000


class _Kept(dict):
    """pre-token -> its ids as bytes, found on first use."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, pre_token: str) -> bytes:
        plain = pre_token.isascii() and pre_token.isprintable()
        word = pre_token.replace(" ", "Ġ") if plain else pre_token.encode().decode("latin-1").translate(BYTE_CHARS)
        got = self[pre_token] = array("H", [t.id for t in self.tokenize(word)]).tobytes()
        return got


class Encoder:
    """ids(texts) -> the ids of each text as bytes. One per worker process and vocabulary."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.lower = self.tokenizer.normalizer is not None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = _Kept(self.tokenizer.model)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, text: str) -> bytes:
        """Without the cache."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole(text)
        if "<|" in text and any(x in text for x in self.special):
            return self.whole(text)
        if len(self.kept) > MOST_KEPT:
            self.kept.clear()
        found = NO_SPACE.findall(text.lower()) if self.lower else KEPT_SPACE.findall(text)
        return b"".join(map(self.kept.__getitem__, found))
