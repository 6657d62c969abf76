"""BPE by dynamic programming over prefixes, and decoding.

Every prefix of a word has one token that its encoding ends in: the vocabulary's token that is a suffix of the prefix and
stands compatibly behind the last token of what is left of the prefix.  An automaton of the vocabulary gives all
suffixes of all prefixes in one pass; two tokens are compatible if no merge across their boundary would have come before
the merges that made them.  The last tokens, followed back from the end of the word, are the ids that merging gives.

Normalizing and cutting to words is the tokenizers library's, by the vocabulary file; added tokens stand for themselves.
A text without words (null, empty, white space) has no ids and decodes to an empty text.  Repeated rows and null
ids are encoded as they stand.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from relayloom.llm.common import documents, pieces
from relayloom.llm.tokens import _Memo

#: Stands for the suffix of a word's last letter; a noncharacter, so no text has it after byte-level mapping.
END = "﷐"
#: Longer words are encoded but not remembered.
MOST_REMEMBERED = 256
#: Pairs of tokens whose compatibility a worker remembers.
MOST_PAIRS = 1 << 19
#: With this pattern ASCII letters, and marks without an apostrophe after them, are one piece each.
LETTERS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_WORD = re.compile(r"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")
#: A normalizer and pre-tokenizer of these kinds treat the parts of a text between two spaces on their own.
APART = ("NFC", "Replace", "Lowercase", "Split", "ByteLevel")


class Merges:
    """Which tokens may follow each other, from the merges of a vocabulary file."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left, right
        for n, (a, b) in enumerate(merges):
            token = vocab[a + b]
            if token in self.made or any(vocab[x] not in self.made and len(x.removesuffix(suffix)) != 1 for x in (a, b)):
                raise ValueError(f"merge {n} makes a token again, or of tokens that are made later")
            self.rank[vocab[a], vocab[b]], self.made[token] = n, (n, vocab[a], vocab[b])
        #: Tokens that merging never makes, as other merges of the same letters come first.
        self.never: set[int] = set()
        for token, (n, left, right) in self.made.items():
            if left in self.never or right in self.never or not self.compatible(left, right, n):
                self.never.add(token)

    def compatible(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether ``b`` can stand behind ``a``: their merges are undone, latest first, and none across the boundary comes earlier.

        Merges across the boundary of a rank below ``limit`` would have come first.  Of two equal merges the left one
        comes first, so one across the boundary precedes an equal one in ``b`` only.
        """
        rank, made = self.rank, self.made
        while True:
            across = rank.get((a, b))
            if across is not None and across < limit:
                return False
            x, y = made.get(a), made.get(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                limit, a = x[0], x[2]
            else:
                limit, b = y[0] + 1, y[1]


class PrefixCoder:
    """Ids of one word of the vocabulary's alphabet, by the last token of every prefix."""

    def __init__(self, model: dict):
        import ahocorasick

        self.suffix = model.get("end_of_word_suffix") or ""
        if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("the vocabulary file asks for more than plain merges")
        vocab = model["vocab"]
        self.merges = Merges(vocab, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], self.suffix)
        self.tokens = ahocorasick.Automaton()
        made = self.merges.made
        for token, number in vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix)
            symbols = token[: -len(self.suffix)] + END if ends else token
            if symbols and number not in self.merges.never and (number in made or len(symbols) == 1 + ends):  # what no merge makes is no token of a word
                self.tokens.add_word(symbols, (len(symbols), number))
        self.tokens.make_automaton()
        self.fits: dict[int, bool] = {}

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merges.compatible(a, b)
        return known

    def encode(self, word: str) -> list[int]:
        if not word:
            return []
        text = word + END if self.suffix else word
        last, size = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        fits = self._fits
        for at, (n, token) in self.tokens.iter(text):
            before, to = at + 1 - n, at + 1
            if last[to] < 0 and (not before or (last[before] >= 0 and fits(last[before], token))):
                last[to], size[to] = token, n
        out, at = [], len(text)
        while at:
            if last[at] < 0:
                raise ValueError("a letter of the text is no token of the vocabulary")
            out.append(last[at])
            at -= size[at]
        return out[::-1]


class Codec:
    """Encodes texts as a vocabulary file of the tokenizers library says, remembering words, and decodes ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        self.tokenizer = Tokenizer.from_file(path)
        if spec["model"]["type"] != "BPE" or spec["post_processor"] or self.tokenizer.decoder is not None:
            raise ValueError("wanted: a BPE vocabulary without post-processor and decoder")
        self.coder = PrefixCoder(spec["model"])
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in added):
            raise ValueError("added tokens must be found in the text as they are")
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        parts = [*_kinds(spec["normalizer"], "normalizers"), *_kinds(spec["pre_tokenizer"], "pretokenizers")]
        self.apart = all(kind in APART for kind in parts) and "Split" in parts
        self.plain = parts == [*APART] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": LETTERS_AND_MARKS}
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names, default=-1) + 1)], pa.string())
        self.pieces, self.words = _Memo(self._piece), _Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        return array("I", self.coder.encode(piece)).tobytes()

    def _word(self, text: str) -> bytes:
        """Ids of a text, usually one between two spaces: added tokens cut out, the rest normalized and cut to words."""
        normal, known, out = self.tokenizer.normalizer, self.pieces, []
        if self.plain and (plain := _PLAIN_WORD.fullmatch(text)) and len(text) <= MOST_REMEMBERED:
            return known[plain[1].lower()] + known[plain[2]]
        for part in self.cut(text):
            if part in self.added:
                out.append(array("I", [self.added[part]]).tobytes())
            elif part:
                part = normal.normalize_str(part) if normal else part
                out += [known[p] if len(p) <= MOST_REMEMBERED else self._piece(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        self.pieces.trim()
        self.words.trim()
        if not self.apart:
            return [self._word(text) for text in texts]
        get = self.words.__getitem__
        return [b"".join([get(w) if len(w) <= MOST_REMEMBERED else self._word(w) for w in text.split(" ")]) for text in texts]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids, special tokens kept: without a decoder the library joins tokens by one space."""
        tokens = self.names.take(ids.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens), " ")


def _kinds(spec: dict | None, name: str) -> list[str]:
    return [] if spec is None else [k for x in spec[name] for k in _kinds(x, name)] if spec["type"] == "Sequence" else [spec["type"]]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file; loaded once and kept with its memory."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of each document of (doc_id, text): nothing is shuffled, a batch is a few MB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer)
        for batch in pieces(batches, "text", most=2 << 20):
            got = coder.encode(batch.column("text").to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), dtype=np.uint32).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, coder.decode(ids)], ["doc_id", "ids", "decoded"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
