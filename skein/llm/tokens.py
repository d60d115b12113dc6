"""Token ids of whole texts, word by word, with bounded caches.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of
its space-separated words one after the other. Within a word, runs of plain or Latin-1
letters are pieces of their own (but for the English endings 's, 't, 're, 've, 'm, 'll, 'd);
words of any other make go to the tokenizer as they are. Tests hold both ways against it.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np

from skein.llm.text import kept, parts

_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_OK = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_APOS = re.compile(r"'(?:s|t|re|ve|m|ll|d)", re.I)


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others are moved up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


class Bounded(dict):
    """key -> make(key), of at most `most` keys (then it starts anew); keys over 64 long are not kept."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        v = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = v
        return v


class WordTokenizer:
    def __init__(self, path: str, words: int = 250_000, pieces: int = 200_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.words, self.pieces = Bounded(self.word, words), Bounded(self.piece, pieces)
        self.chars = {ord(bytes([b]).decode("latin-1")): c for b, c in _byte_chars().items()}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, p: str) -> bytes:
        s = p if p.isascii() else p.encode().decode("latin-1").translate(self.chars)
        ids = [t.id for t in self.model.tokenize(s)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, w: bytes) -> bytes:
        if w.isalpha():  # plain letters only
            return self.pieces[w.lower().decode()]
        t = w.decode()
        if _OK.fullmatch(t) and not ("'" in t and _APOS.search(t)) and "<|" not in t:
            t = t.lower()
            return self.pieces[t] if t.isalpha() else b"".join(map(self.pieces.__getitem__, _PLAIN.findall(t)))
        return self.whole(t)

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a UTF-8 text."""
        return b"".join(map(self._part, parts(text)))

    def _part(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and stage."""
    return kept(("tokenizer", path), lambda: WordTokenizer(path))
