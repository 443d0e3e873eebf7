"""Token ids of a public tokenizer, word by word, with a bounded cache."""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Words remembered by one Python worker, about 100 MB.
CACHE = 500_000

_LETTER = "a-zß-öø-ÿ"
#: Texts of these characters alone are cut into words here; the vocabulary's own rules do the same.
_PLAIN = re.compile("[\\x00-\\x7FÀ-ÖØ-öø-ÿ]*")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\t-\\r {_LETTER}0-9]+")


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 16-bit bytes.

    The vocabulary lower-cases, drops white space and encodes each word by
    itself, so a plain text's ids are those of its words, one after another:
    known words come from the cache, new ones from the tokenizer's model. Any other text (other scripts, combining marks, special tokens) goes
    through the tokenizer as a whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tok = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        size = self._tok.get_vocab_size()
        assert size <= 1 << 16, "ids must fit 16 bits"
        self._model = self._tok.model
        # byte-level vocabularies spell each byte as one printable character
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self._spelling = {b: 256 + k for k, b in enumerate(others)}
        self._seen: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.asarray(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _learn(self, words: set[str]) -> None:
        tokenize = self._model.tokenize
        for word in words:
            spelled = word.encode().decode("latin-1").translate(self._spelling)
            self._seen[word] = struct.pack(f"<{len(got := tokenize(spelled))}H", *[t.id for t in got])

    def encode(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return self._ids(text)
        words = _WORD.findall(text.lower())
        new = set(words).difference(self._seen)
        if new:
            if len(self._seen) > CACHE:
                self._seen = {}
                new = set(words)
            self._learn(new)
        return b"".join(map(self._seen.__getitem__, words))


@lru_cache(maxsize=1)
def encoder(vocabulary: str = VOCABULARY) -> WordEncoder:
    """The encoder of this Python worker; its cache serves task after task."""
    return WordEncoder(vocabulary)
