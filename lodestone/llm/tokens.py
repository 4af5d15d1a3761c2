"""Token ids of the public word-level BPE, with a bounded cache of words.

White space never lies inside a token of this tokenizer and words are encoded one by one, so
the ids of a text are the ids of its white-space runs one after another. Texts for which that
does not hold (the strings of special tokens, separators that only Python counts as white
space, characters that NFC changes) go through the tokenizer as a whole.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Words kept at a time in each Python worker, about 200 bytes each.
CACHE_WORDS = 400_000
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD = re.compile(r"<\||[\x1c-\x1fİ]")
_LOADED: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "WordEncoder":
    """One encoder for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def release() -> None:
    """Drop this process's encoders and their words."""
    _LOADED.clear()


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable bytes name themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of words; what is missing is encoded, and all are dropped when there are too many."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        out = self.encode(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = out
        return out


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(_PIECES).findall
        self.names = str.maketrans(_byte_names())
        self.pieces = _Words(self._piece, cache_words)
        self.words = _Words(self._word, cache_words)

    def _piece(self, piece: str) -> bytes:
        name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.names)
        return np.array([t.id for t in self.model.tokenize(name)], "<u2").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(word)))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 16-bit numbers."""
        if not text:
            return np.zeros(0, "<u2")
        if _ODD.search(text) or not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2")
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.lower().split())), "<u2")
