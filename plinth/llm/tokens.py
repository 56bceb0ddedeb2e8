"""Token ids by the tokenizers library, with exact word memoisation.

A text is cut before every space that a non-space character follows; no pre-token spans such a cut, so the pieces'
ids joined are the whole text's ids.  Each distinct piece is encoded once while it is remembered, and kept as
little-endian bytes.  Texts with a space before white space or the end, and those that hold an added token such as
<|endoftext|>, go to the library as a whole.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from functools import lru_cache
from operator import attrgetter

import pyarrow as pa

END = (0).to_bytes(4, "little")
_ID = attrgetter("id")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: ASCII punctuation that both vocabularies' patterns keep together; the apostrophe starts contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class _Whole(Exception):
    """The text can't be cut at every space."""


class _Pieces(dict):
    """Ids of what follows a space.  Two generations: when the young one is full it becomes the old one."""

    def __init__(self, encoder: Encoder, most: int):
        super().__init__()
        self.encoder, self.most, self.old = encoder, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word.isalpha() and (word.isascii() or _LATIN(word)):
                found = self.encoder.letters(word, True)
            elif not word or word[0].isspace():
                raise _Whole
            else:
                found = self.encoder.piece(word, True)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


class Encoder:
    """encode(text) -> the ids' bytes, little-endian unsigned 32 bits each, without an end id."""

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        with open(path, encoding="utf-8") as f:
            self.lower = "Lowercase" in json.dumps(json.load(f)["normalizer"])
        self.model, self.chars = self.tokenizer.model.tokenize, "".join(_byte_chars())
        self.space = "" if self.lower else self.chars[32]
        self.newline = self.whole("\n")
        self.marks: dict[str, bytes] = {}
        self.pieces = _Pieces(self, most)
        self.lines = _Pieces(self, most // 4)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str, spaced: bool) -> bytes:
        """Ids of one pre-token of Latin letters, straight from the library's model."""
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = codecs.charmap_decode(word.encode(), "strict", self.chars)[0]
        return array("I", map(_ID, self.model(self.space + word if spaced else word))).tobytes()

    def punctuation(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[marks] = found = self.whole(marks)
        return found

    def piece(self, word: str, spaced: bool) -> bytes:
        """Ids of a word without white space at its start, after a space or (not spaced) at a line's start."""
        if word.isalpha() and (word.isascii() or _LATIN(word)):
            return self.letters(word, spaced)
        head = word.rstrip(_MARKS)
        if head and head.isalpha() and (head.isascii() or _LATIN(head)):
            return (self.pieces[head] if spaced else self.letters(head, False)) + self.punctuation(word[len(head) :])
        if "\n" in word:  # single line ends between words are pre-tokens of their own
            first, *rest = word.split("\n")
            if all(p and p.split() == [p] for p in (first, *rest)):
                return (self.pieces[first] if spaced else self.line(first)) + b"".join([self.newline + self.line(p) for p in rest])
        return self.whole(" " + word if spaced else word)

    def line(self, word: str) -> bytes:
        found = self.lines.get(word)
        if found is None:
            found = self.lines.old.get(word) or self.piece(word, False)
            if len(self.lines) >= self.lines.most:
                self.lines.old = dict(self.lines)
                self.lines.clear()
            self.lines[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added(text):
            return self.whole(text)
        try:
            first, *rest = text.split(" ")
            head = (self.line(first) if not first[0].isspace() else self.whole(first)) if first else b""
            return head + b"".join(map(self.pieces.__getitem__, rest))
        except _Whole:
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(path: str, most: int = 250_000) -> Encoder:
    """One a Python worker."""
    return Encoder(path, most)


def ids_array(parts: list[bytes]) -> pa.Array:
    """A list<int32> array of the parts, without a copy an id."""
    import numpy as np

    ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))
