"""Toxicity scores behind a noisy-channel decoder for disguised words.

1. A character language model: trigram counts over the texts of all documents, added up by a
   shuffle.  Its table has one cell for each of 64 ** 3 character triples, whatever the input; letters
   beyond Latin-1 share a class, so the model tells them from other letters but not from each other.
2. All words but plain ones (letters only, none twice in a row), and runs of four or more single
   characters, become a lattice: each character may be itself, a letter that it imitates, a
   separator, or nothing (a mark, a space or a repeated letter).  Viterbi decoding finds the best
   path under channel costs plus the language model; no state is left out.  Two or three neighbouring words that
   together spell a weighed word are decoded as one lattice, too.
3. Features of the restored words (the word, and its first four and five letters) get log odds from
   labelled documents: how much likelier a document with the feature is toxic than any document.  Features
   held by fewer than ``least_docs`` toxic documents, or without positive log odds, weigh nothing.
4. A document's evidence is its three largest weights (of words that begin differently) and its length.
   A logistic regression on it gives the score; it is fitted on evidence from weights of the other half
   of the training documents, so no document testifies for itself.

The classifier is fitted on at most ``sample_rows`` labelled documents, those with the least hashed ids
of the training part, and keeps at most ``most_features`` weights; near copies among the documents
(links of one round of stars, confirmed at 85 percent of word shingles, see ``near.without_copies``) with equal labels count once.  The
training part leaves out every ``doc_id`` whose crc32 as text is a multiple of 5.  Labels, language,
source and id never enter a score.  Null and empty texts get the score of no evidence.  Rows with equal
or null ``doc_id`` are scored each by its own text; a label that is null or repeated with another value
is not used.  Without training labels all scores are 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayloom.llm import near, tokens
from relayloom.llm.common import documents, pieces, written

SIZE = 64
#: What a character may stand for when it disguises a letter.
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs in nats of the channel: a disguise, a mark that is dropped, a repeated letter that is dropped, a dropped
#: or separating character that could be a disguise.
DISGUISE, DROP, REPEAT, LOST = 1.0, 0.5, 0.5, 8.0
FEATURES = "doc_id long, toxic int, n_words long, features array<string>"
_TWICE, _THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
#: Marks around a word that stand for no letter.
MARKS = "\"'.,;:?)[]{}*%#&~_-<>/\\"


def _classes() -> np.ndarray:
    """Character code to class: a-z 1 to 26, the letters of Latin-1 from 27, other letters 63, the rest 0."""
    table = np.zeros(0x250, dtype=np.int64)
    for code in range(0x250):
        low = chr(code).lower()
        if len(low) == 1 and "a" <= low <= "z":
            table[code] = ord(low) - 96
        elif low.isalpha():
            table[code] = 27 + ord(low) - 0xDF if len(low) == 1 and 0xDF <= ord(low) <= 0xFF else 63
    return table


CLASSES = _classes()


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(code < 0x250, CLASSES[np.minimum(code, 0x24F)], 63)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    count = np.zeros(SIZE**3, dtype=np.int64)
    for batch in pieces(batches, "text", 1 << 20):
        c = classes("\n".join(["", *batch.column("text").to_pylist(), ""]))
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one boundary between words
        count += np.bincount(c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:], minlength=SIZE**3)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["cell", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a character class after two others; at most SIZE ** 3 numbers reach the driver."""
    rows = documents(docs).mapInArrow(_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(SIZE**3)
    for r in rows:
        count[r.cell] = r.n
    three = count.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 10 * p1) / (two.sum(axis=1, keepdims=True) + 10)
    return np.log((three + 10 * p2) / (three.sum(axis=2, keepdims=True) + 10)).astype(np.float32)


class _Letters(dict):
    """The class of a lower-case character, worked out once."""

    def __missing__(self, ch: str) -> int:
        self[ch] = found = int(classes(ch)[0])
        return found


_LETTERS = _Letters({" ": 0})


def _options(ch: str, repeats: bool) -> tuple[list[tuple[str, int, float]], float | None, float | None]:
    """What a character may be: letters (with class and cost), and the costs of dropping it and of a separator."""
    letters = [(x, _LETTERS[x], DISGUISE) for x in IMITATES.get(ch, "")]
    drop = apart = None
    if ch.isalpha():
        letters.append((ch, _LETTERS[ch], 0.0))
    else:
        drop, apart = (LOST, LOST) if ch in IMITATES else (DROP, 0.0)
    if repeats:
        drop = REPEAT if drop is None else min(drop, REPEAT)
    return letters, drop, apart


class _Options(dict):
    def __missing__(self, key: tuple[str, bool]):
        self[key] = found = _options(*key)
        return found


_OPTIONS = _Options()
_RUNS = re.compile(r"(.)\1+")
_APART = re.compile(r"[\W\d_]+")
_SPACED = re.compile(rb"\x01{4,}")
#: Tokens are decoded in parts of so many characters, which overlap by half.
PART = 48


def decode(token: str, model: list[list[list[float]]], run: int = 2) -> str:
    """The most likely plain text of a disguised token (lower case; spaces are separators).

    Characters may be dropped as repeats in runs of at least ``run``.
    """
    token = token.lower()
    long_run = {i for m in _RUNS.finditer(token) if m.end() - m.start() >= run for i in range(m.start() + 1, m.end())}
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for place, ch in enumerate(token):
        letters, dropped, apart = _OPTIONS[ch, place in long_run]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        if len(best) == 1 and dropped is None and len(letters) == 1:  # one path: a plain letter
            ((a, b), (cost, text)), (x, c, extra) = *best.items(), letters[0]
            best = {(b, c): (cost + extra - model[a][b][c], text + x)}
            continue
        for state, (cost, text) in best.items():
            b = state[1]
            row = model[state[0]][b]
            stay = dropped if b or apart is None else apart if dropped is None else min(dropped, apart)
            if stay is not None and (state not in after or cost + stay < after[state][0]):
                after[state] = (cost + stay, text)
            for x, c, extra in letters if not b or apart is None else [*letters, (" ", 0, apart)]:
                to, total = (b, c), cost + extra - row[c]
                if to not in after or total < after[to][0]:
                    after[to] = (total, text + x)
        best = after
    ends = [(cost - model[a][b][0] * (b != 0), text) for (a, b), (cost, text) in best.items()]
    return min(ends)[1].strip() if ends else ""


def decode_all(token: str, model: list[list[list[float]]], length: int = PART) -> list[str]:
    """Words of a decoded token; a long one is decoded in parts that overlap by half.

    Double letters give two readings: one that may drop a repeat, and one that may do so in longer runs only.
    """
    out = []
    for at in range(0, max(1, len(token)), length):
        part = token[max(0, at - length // 2) : at + length]
        runs = [3] if _THRICE.search(part) or not part.isalpha() else []  # else that reading is the part itself
        for run in [*runs, 2] if _TWICE.search(part) else runs or [3]:
            found = decode(part, model, run).split()
            out += found if len(found) < 2 else [*found, "".join(found)]  # also read without separators
    return out


def sure(core: str) -> list[str]:
    """The readings of a token without its marks that take no decoding."""
    if core.isalpha():
        return [core]
    plain = core.rstrip("!$@|+(0123456789")
    return [x for x in _APART.split(core) if x] + ([plain] if plain.isalpha() else [])


class Restorer:
    """Words of a text with disguises undone."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def word(self, w: str) -> list[str]:
        """Restored words of one token; all but letters without a repeat may be a disguise and give all readings."""
        core = w.lower().strip(MARKS)
        if not core or (core.isalpha() and not _TWICE.search(core)):
            return [core] if core else []
        return list(dict.fromkeys(sure(core) + decode_all(core, self.model)))

    def spaced(self, tokens: list[str]) -> list[str]:
        """Words out of runs of four or more single characters."""
        single = bytes(map((1).__eq__, map(len, tokens)))
        return [w for run in _SPACED.finditer(single) for w in decode_all(" ".join(tokens[run.start() : run.end()]), self.model)]

    def tokens(self, text: str) -> tuple[list[str], list[str]]:
        cut = text.split()
        return cut, self.spaced(cut) if list(map(len, cut)).count(1) >= 4 else []


def features(word: str) -> list[str]:
    out = [word + "$"]
    if len(word) > 3:
        out.append("^" + word[:4])
    if len(word) > 4:
        out.append("^" + word[:5])
    return out


#: Beginnings of words with their weights.
Held = tuple[tuple[str, float], ...]


class Model(NamedTuple):
    characters: np.ndarray
    weights: dict[str, float]
    #: Coefficients of the three largest weights, of the length and of one; none without training labels.
    fit: tuple[float, ...] | None


def _described(model: np.ndarray, most_words: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, known = Restorer(model), {}
        for batch in pieces(batches, "text", 1 << 20):
            if len(known) > most_words:
                known.clear()
            found, lengths = [], []
            for text in batch.column("text").to_pylist():
                plain, more = restore.tokens(text)
                for w in plain:
                    if w not in known:
                        known[w] = restore.word(w)
                restored = {r for w in set(plain) for r in known[w]} | set(more)
                found.append(sorted({f for w in restored for f in features(w)}))
                lengths.append(len(plain))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "toxic", "n_words", "features"])

    return run


def evidence(held: dict[str, float], n_words: int) -> tuple[float, ...]:
    """The three largest weights of word beginnings, the length, and one."""
    top = sorted(held.values(), reverse=True)[:3]
    return (*top, *[0.0] * (3 - len(top)), math.log1p(n_words), 1.0)


#: Ridge penalties of the three weights, the length and one: a single word may suffice, so the second and third count for less.
PENALTIES = (0.1, 10.0, 10.0, 1.0, 1e-6)


def logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _weights(train: DataFrame, most_features: int, prior_docs: float, least_docs: int) -> dict[str, float]:
    """Positive log odds of features, smoothed by ``prior_docs`` documents of the base rate."""
    total = train.agg(F.count("*").alias("n"), F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("base")).first()
    if not 0 < total.base < 1:
        return {}
    counted = train.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).where(F.col("pos") >= least_docs)
    odds = F.log((F.col("pos") + prior_docs * total.base) / (F.col("n") - F.col("pos") + prior_docs * (1 - total.base))) - math.log(total.base / (1 - total.base))
    top = counted.select("feature", odds.alias("w")).where("w > 0").orderBy(F.desc("w"), "feature").limit(most_features)
    return {r.feature: float(r.w) for r in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, most_features: int = 50_000, prior_docs: float = 5.0, least_docs: int = 4) -> Model:
    """The character model of all documents, and a classifier fitted on a bounded sample of labelled ones."""
    docs = documents(docs)
    characters = character_model(docs)
    clean = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other and toxic in (0, 1) and doc_id is not null")
    chosen = clean.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = written(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "toxic-sample")  # sample_rows labels
    first = near.without_copies(sample, within="toxic", k=5, percent=85)
    train = written(sample.join(first, "doc_id", "left_semi").mapInArrow(_described(characters), FEATURES).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")), "toxic-train")
    halves = [_weights(train.where(F.col("half") != h), most_features, prior_docs, least_docs) for h in (0, 1)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for half, n, found in zip(*[batch.column(c).to_pylist() for c in ("half", "n_words", "features")], strict=True):
                held: dict[str, float] = {}
                for f in found:
                    w = halves[half].get(f, 0.0)
                    key = begins(f)
                    if w > held.get(key, 0.0):
                        held[key] = w
                rows.append(evidence(held, n))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))], ["toxic", "x"])

    rows = train.select("half", "n_words", "features", "toxic").mapInArrow(judged, "toxic int, x array<double>").collect()  # sample_rows of five numbers
    if not rows or len({r.toxic for r in rows}) < 2:
        return Model(characters, {}, None)
    coefficients = logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], dtype=float), np.array(PENALTIES))
    return Model(characters, _weights(train, most_features, prior_docs, least_docs), tuple(coefficients))


def begins(feature: str) -> str:
    """The first four letters of a feature's word."""
    return feature.rstrip("$").lstrip("^")[:4]


class _Known(dict):
    """By token: what it holds by readings that take no decoding, and in ``unsure`` what else decoding may find.

    A class of the module, as one made for a task would be garbage that waits for Python's rare full collections.
    """

    def __init__(self, judge: Callable[[str], tuple[Held, Held]]):
        self.judge, self.unsure, self.same = judge, {}, {}

    def __missing__(self, w: str) -> Held:
        core = w.strip(MARKS)
        if core == w:
            found, more = self.judge(w)
            found = self.same.setdefault(found, found)  # most words share what their beginnings hold
            if more:
                self.unsure[w] = self.same.setdefault(more, more)
        else:
            found = self[core]
            if core in self.unsure:
                self.unsure[w] = self.unsure[core]
        self[w] = found
        return found

    def forget(self) -> None:
        for kept in (self, self.unsure, self.same):
            kept.clear()


def _scorer(model: Model, most_words: int = 400_000) -> Callable[[list[str]], list[float]]:
    """Scores of texts; made once a task, it remembers words."""
    restore = Restorer(model.characters)
    whole = {f[:-1]: x for f, x in model.weights.items() if f[0] != "^"}
    first = {f[1:]: x for f, x in model.weights.items() if f[0] == "^"}
    heads = {w[:n] for w in whole for n in range(1, len(w))}
    some = {w[:n] for w in first for n in range(1, len(w) + 1)} | heads | set(whole) | {""}
    coefficients = np.array(model.fit if model.fit is not None else [0.0] * 5)

    def weight(w: str) -> float:
        return max(whole.get(w, 0.0), first.get(w[:4], 0.0), first.get(w[:5], 0.0))

    def weigh(words: list[str]) -> Held:
        """Beginnings and largest weights of those words that weigh anything."""
        found: dict[str, float] = {}
        for w in words:
            if (x := weight(w)) > found.get(w[:4], 0.0):
                found[w[:4]] = x
        return tuple(found.items())

    def most(core: str, at: int = 0) -> Held:
        """What ``weigh`` may give at most for the words that decoding can read in a token of one part.

        A walk over the beginnings of weighed words: each character may be what it imitates or be dropped; words begin
        at the token's start and after characters that may separate.  The first ``at`` characters are what they are.
        """
        now, last, found = {core[:at]} & some, len(core) - 1, {}
        if at:
            found = {s[:4]: whole.get(s, 0.0) for s in now}
        for i in range(at, last + 1):
            ch = core[i]
            letter = ch.isalpha()
            new = {t for s in now for x in (ch if letter else IMITATES.get(ch, "")) if (t := s + x) in some}
            ends = i == last or core[i + 1] == ch or not core[i + 1].isalpha()
            for t in new:
                x = max(first.get(t, 0.0), whole.get(t, 0.0) if ends else 0.0)
                if x > found.get(t[:4], 0.0):
                    found[t[:4]] = x
            if not letter:
                now |= new | {""}
            elif i and ch == core[i - 1]:
                now |= new
            else:
                now = new
            if at and not now:
                break
        return tuple(found.items())

    def judge(core: str) -> tuple[Held, Held]:
        """What a token without its marks holds for sure, and what decoding may find beyond; a token of more parts is decoded."""
        if len(core) > PART:
            return weigh(restore.word(core)), ()
        if not core.isalpha():
            found, bound = weigh(sure(core)), most(core)
        else:
            found, twice = ((core[:4], x),) if (x := weight(core)) else (), _TWICE.search(core)
            bound = most(core, twice.start() + 1) if twice else ()
        if bound:
            least = dict(found)
            bound = tuple((b, x) for b, x in bound if x > least.get(b, 0.0))
        return found, bound

    known = _Known(judge)

    def apart(tokens: list[str]) -> Iterator[tuple[str, str]]:
        """Weighed words that two or three neighbouring tokens may spell, and these tokens."""
        for i in compress(range(len(tokens) - 1), map(heads.__contains__, tokens)):
            two = tokens[i] + tokens[i + 1]
            if two in some:
                for n, w in ((2, two), (3, "".join(tokens[i : i + 3]))):
                    if w in whole:
                        yield w, " ".join(tokens[i : i + n])

    def holds(tokens: list[str], more: list[str]) -> dict[str, float]:
        """Weights of a text by beginnings of words; of those that can't be among the three largest, some are left out."""
        held: dict[str, float] = {}

        def take(found: Iterable[tuple[str, float]]) -> float:
            for b, x in found:
                if x > held.get(b, 0.0):
                    held[b] = x
            return sorted(held.values())[-3] if len(held) > 2 else 0.0

        words = set(tokens)
        third = take(chain(weigh(more), chain.from_iterable(filter(None, map(known.__getitem__, words)))))
        for w in known.unsure.keys() & words:
            if any(x > third and x > held.get(b, 0.0) for b, x in known.unsure[w]):
                del known.unsure[w]
                known[w] = found = weigh(restore.word(w))
                third = take(found)
        for w, spelled in apart(tokens):
            x = weight(w)
            if x > third and x > held.get(w[:4], 0.0) and decode(spelled, restore.model) == w:
                third = take([(w[:4], x)])
        return held

    def rate(texts: list[str]) -> list[float]:
        if model.fit is None:
            return [0.0] * len(texts)
        if len(known) > most_words:
            known.forget()
        rows = []
        for text in texts:
            plain, more = restore.tokens(text.lower())
            rows.append(evidence(holds(plain, more), len(plain)))
        return (1 / (1 + np.exp(-np.clip(np.array(rows) @ coefficients, -30, 30)))).tolist() if rows else []

    return rate


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of all documents, computed where the texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        rate = _scorer(model)
        for batch in pieces(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rate(batch.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under ``threshold``, all columns as they were; null texts, null ids and repeated rows are judged by their text."""
    model = fit(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        rate = _scorer(model)
        for batch in pieces(batches, "text", 1 << 20):
            yield batch.filter(pa.array([x < threshold for x in rate([t or "" for t in batch.column("text").to_pylist()])], pa.bool_()))

    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # mapInArrow can't name every column
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
