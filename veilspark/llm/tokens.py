"""Fast exact token ids: the public tokenizer's merges behind a cache of words.

The tokenizer lower-cases, drops white space, cuts words into pieces (letters, single digits, runs of
marks) and merges bytes inside a piece only, so a text's ids are its words' ids in order. For texts of
printable ASCII and Latin-1, Python cuts the same words and pieces; the tokenizer's model
merges the pieces, and the words' ids are cached for the life of a worker, in two generations of
a fixed number of entries. Other texts, and texts that spell a special token, go to the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, count

import numpy as np

#: Words in each of the two generations, and an eighth of their ids.
CACHE_ENTRIES = 250_000
#: Latin-1 text without control codes and without digits beyond 0-9.
_SIMPLE = re.compile(r"[\x09-\x0d\x20-\x7e\xa0-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]*")
#: The tokenizer file's own split pattern, as it reads for the characters of _SIMPLE, and its special tokens (fixed values).
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: Byte-level alphabet: a byte that prints stands for itself, the others for the code points from 256 on, in order.
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


class _Generation:
    """Word -> position of its ids in a flat array."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.flat, self.at = array("I"), array("q", [0])

    def add(self, words: list[str], sizes: np.ndarray, ids) -> None:
        """``words`` with their ids one behind the other, ``sizes`` of them each."""
        self.codes.update(zip(words, count(len(self.at) - 1)))
        self.at.frombytes((np.cumsum(sizes, dtype=np.int64) + self.at[-1]).tobytes())
        self.flat.extend(ids)

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each code, the ids one behind the other)."""
        at, flat = np.frombuffer(self.at, np.int64), np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.empty(0, np.uint32)
        start, size = at[codes], at[codes + 1] - at[codes]
        total = np.cumsum(size) - size
        return size, flat[np.arange(int(size.sum())) + np.repeat(start - total, size)]


class Coder:
    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.entries = entries
        self.now, self.old = _Generation(), _Generation()

    def _merged(self, words: list[str]) -> list[list[int]]:
        met: dict[str, list[int]] = {}
        out = []
        for w in words:
            pieces = [w] if w.isalpha() else _PIECES.findall(w)
            for p in pieces:
                if p not in met:
                    spelled = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)
                    met[p] = [token.id for token in self.merge(spelled)]
            out.append(met[w] if len(pieces) == 1 and pieces[0] == w else [i for p in pieces for i in met[p]])
        return out

    def _learn(self, missing: set[str]) -> None:
        now, old = self.now, self.old
        if known := list(old.codes.keys() & missing):
            size, ids = old.ids(np.fromiter(map(old.codes.__getitem__, known), np.int64, len(known)))
            now.add(known, size, array("I", ids.tobytes()))
            missing.difference_update(known)
        words = list(missing)
        merged = self._merged(words)
        now.add(words, np.fromiter(map(len, merged), np.int64, len(words)), chain.from_iterable(merged))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as uint32 arrays."""
        if len(self.now.codes) > self.entries or len(self.now.flat) > 8 * self.entries:
            self.old, self.now = self.now, _Generation()
        odd = {i for i, t in enumerate(texts) if not _SIMPLE.fullmatch(t) or _SPECIAL.search(t)}
        words = [[] if i in odd else t.lower().split() for i, t in enumerate(texts)]
        if missing := set(chain.from_iterable(words)).difference(self.now.codes):
            self._learn(missing)
        counts = np.array([len(row) for row in words], np.int64)
        codes = np.fromiter(map(self.now.codes.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        size, ids = self.now.ids(codes)
        edges = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        out = [ids[edges[i] : edges[i + 1]] for i in range(len(texts))]
        for i in odd:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The worker's coder for a tokenizer file, made once."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]
