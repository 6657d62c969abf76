"""Fast encoding with a public byte-level BPE vocabulary of the tokenizers library."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable
from pathlib import Path

import regex

#: Remembered words, and pre-tokens, of a Python worker: so many new ones, and as many from before.
MOST_PIECES = 400_000
#: Byte-level BPE's pre-tokens, for the regex module.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: ASCII marks that are no letter, digit or white space: after letters they are one pre-token.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _printable() -> dict[int, str]:
    """Byte-level BPE's rule: bytes that print stand for themselves, the rest for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Memo(dict):
    """Works out a value on its first use.  A full table becomes the old one, whose values come back when they are used again."""

    def __init__(self, find: Callable[[str], bytes | bool]):
        self.find, self.old = find, {}

    def __missing__(self, w: str) -> bytes | bool:
        found = self.old.get(w)
        self[w] = found = self.find(w) if found is None else found
        return found

    def trim(self) -> None:
        if len(self) > MOST_PIECES:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.old = {}
        self.clear()


class Encoder:
    """Encodes texts to unsigned 32-bit ids of the machine's (little-endian) order, remembering words.

    Byte-level BPE never merges across a pre-token, and a single space before a character
    that is no white space always starts one.  So a text cut there encodes piece by piece to
    the same ids.  A word of letters, with or without marks after them, is one or two pre-tokens
    that go straight to the library's BPE model; other words are split into pre-tokens first.  A text
    in which some space is followed by white space or by the end goes to it uncut, and so do all
    texts where the vocabulary file has another pre-tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        kind = json.loads(Path(path).read_text())
        before = kind["pre_tokenizer"] or {}
        self.cuts = kind["normalizer"] is None and kind["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.known, self.parts = _Memo(self.word), _Memo(self.part)
        self.pretokens = regex.compile(PRETOKENS).findall
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.printable = _printable()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def part(self, pretoken: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(pretoken.encode().decode("latin-1").translate(self.printable))]).tobytes()

    def word(self, w: str) -> bytes | bool:
        """Ids of a word after a space; False for what must not be cut off there."""
        if not w or w[0].isspace():
            return False
        letters = w.rstrip(MARKS)
        if not letters.isalpha():
            return b"".join(map(self.parts.__getitem__, self.pretokens(" " + w)))
        if len(letters) == len(w):
            return self.part(" " + w)
        return self.known[letters] + self.parts[w[len(letters) :]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if not self.cuts:
            return self.whole(texts)
        self.known.trim()
        self.parts.trim()
        cut = [text.split(" ") for text in texts]
        heads = self.whole([words[0] for words in cut])
        get = self.known.__getitem__
        out: list[bytes] = []
        for text, words, head in zip(texts, cut, heads, strict=True):
            got = list(map(get, words))
            got[0] = head
            if False in got or any(s in text for s in self.specials):
                out += self.whole([text])
            else:
                out.append(b"".join(got))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; loaded once and kept with its memory."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Frees the words that the worker's encoders remember; for tasks of other operators, which may follow in the same worker."""
    for e in _ENCODERS.values():
        e.known.forget()
        e.parts.forget()
