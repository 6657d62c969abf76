"""Keyword scores of many queries against texts, where only the pairs that share something cost anything."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from relayloom.functions import vocabulary as V

#: Points of a whole query in the title, of an overlapping keyword, and of each whole query in the text.
TITLE, KEYWORD, PHRASE = 10, 5, 2
#: Keywords whose queries a task remembers.
REMEMBERED = 20_000
_NONE = np.zeros(0, dtype=np.int64)
_WORD, _PLAIN, _STOP = re.compile(r"\w+"), re.compile("[a-z]{3,}"), frozenset(V.STOP_WORDS)


def frequent_words(text: str, most: int = 10) -> list[str]:
    """A lower-case text's most frequent words of three ASCII letters or more that are no stop words, ties by first place."""
    counted = [(n, w) for w, n in Counter(_WORD.findall(text)).items() if w not in _STOP and _PLAIN.fullmatch(w)]
    return [w for _, w in sorted(counted, key=lambda x: -x[0])[:most]]


def _automaton(words: Iterable[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


class QueryIndex:
    """Lower-case queries by what a document may hold of them: their words, the whole of them, parts of them.

    One automaton has all words of all queries and one all whole queries, so a text is read twice whatever the number of
    queries.  A word leads to its postings, the queries that have it (as often as they do); a keyword leads to the
    queries around it by its rarest run of three letters.
    """

    def __init__(self, queries: list[str], wanted: list[str | None]):
        self.n = len(queries)
        self.anywhere = np.array([w is None for w in wanted], dtype=bool)
        self.wanted = np.array([w if w is not None else "" for w in wanted], dtype=object)
        of_word: dict[str, list[int]] = {}
        of_phrase: dict[str, list[int]] = {}
        for i, q in enumerate(queries):
            of_phrase.setdefault(q, []).append(i)
            for w in q.split():
                of_word.setdefault(w, []).append(i)
        as_array = lambda lists: [np.array(x, dtype=np.int64) for x in lists]
        self.words = _automaton(of_word)
        self.n_postings = np.array([len(x) for x in of_word.values()], dtype=np.int64)
        self.postings = np.array([i for x in of_word.values() for i in x], dtype=np.int64)
        self.first_posting = np.cumsum(self.n_postings) - self.n_postings
        self.phrases, self.by_phrase, self.said = _automaton(of_phrase), as_array(of_phrase.values()), list(of_phrase)
        grams: dict[str, list[int]] = {}
        for number, q in enumerate(self.said):
            for gram in {q[i : i + n] for n in (1, 2, 3) for i in range(len(q) - n + 1)}:
                grams.setdefault(gram, []).append(number)
        self.grams = {g: np.array(x, dtype=np.int32) for g, x in grams.items()}
        self.of_category: dict[str | None, np.ndarray] = {}
        self.of_keyword: dict[str, np.ndarray] = {}

    def overlaps(self, keyword: str) -> np.ndarray:
        """The queries that hold the keyword or lie in it."""
        if keyword not in self.of_keyword:
            if len(self.of_keyword) >= REMEMBERED:
                self.of_keyword.clear()
            found = {n for _, n in self.phrases.iter(keyword)}
            if not keyword:
                found |= set(range(len(self.said)))
            else:
                near = [self.grams.get(keyword[i : i + 3], _NONE) for i in range(max(1, len(keyword) - 2))]
                found |= {n for n in min(near, key=len).tolist() if keyword in self.said[n]}
            self.of_keyword[keyword] = np.concatenate([self.by_phrase[n] for n in found]) if found else _NONE
        return self.of_keyword[keyword]

    def _times(self, text: str) -> dict[int, int]:
        """How often each whole query stands in the text, without overlaps."""
        times: Counter[int] = Counter()
        free: dict[int, int] = {}
        for end, n in self.phrases.iter(text):
            if end - len(self.said[n]) >= free.get(n, -1):
                times[n] += 1
                free[n] = end
        return times

    def scores(self, title: str, text: str, keywords: list[str], category: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(queries, points) of all queries of the category that get any."""
        held = {w for _, w in self.words.iter(text)}
        words = np.fromiter(held, dtype=np.int64, count=len(held))
        n = self.n_postings[words]
        at = [self.postings[np.repeat(self.first_posting[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
        points = [1]
        more = [(self.overlaps(x), KEYWORD) for x in keywords]
        more += [(self.by_phrase[n], TITLE) for n in {n for _, n in self.phrases.iter(title)}]
        more += [(self.by_phrase[n], PHRASE * times) for n, times in self._times(text).items()]
        at += [x for x, _ in more]
        points += [x for _, x in more]
        flat, each = np.concatenate(at), np.repeat(points, [len(x) for x in at])
        if not len(flat):
            return _NONE, _NONE
        if 8 * len(flat) < self.n:
            found, back = np.unique(flat, return_inverse=True)
            total = np.bincount(back, each)
        else:
            total = np.bincount(flat, each, self.n)
            found = np.flatnonzero(total)
            total = total[found]
        mine = self.anywhere[found] | (self.wanted[found] == category)
        return found[mine], total[mine].astype(np.int64)


class Best:
    """The k best (points, smallest id) of each query: a heap for each that has met anything."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.ones(n, dtype=np.int64)
        self.heaps: dict[int, list[tuple[int, int]]] = {}

    def offer(self, queries: np.ndarray, points: np.ndarray, doc_id: int) -> None:
        good = points >= self.least[queries]
        for q, p in zip(queries[good].tolist(), points[good].tolist(), strict=True):
            heap = self.heaps.setdefault(q, [])
            if len(heap) < self.k:
                heapq.heappush(heap, (p, -doc_id))
            elif (p, -doc_id) > heap[0]:
                heapq.heapreplace(heap, (p, -doc_id))
            if len(heap) == self.k:
                self.least[q] = heap[0][0]

    def rows(self) -> list[tuple[int, int, int]]:
        return [(q, -doc, p) for q, heap in self.heaps.items() for p, doc in heap]


def scorer(ids: list, queries: list[str], wanted: list[str | None], k: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over batches of (doc_id, title, text, keywords, category): its k best documents of each query.

    Where keywords are null, those of the text are worked out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, best = QueryIndex(queries, wanted), Best(len(queries), k)
        for batch in batches:
            for doc_id, title, text, keywords, category in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "title", "text", "keywords", "category")], strict=True):
                best.offer(*index.scores(title, text, frequent_words(text) if keywords is None else keywords, category), doc_id)
        rows = best.rows()
        if rows:
            q, docs, points = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], id_type), pa.array(docs, pa.int64()), pa.array(points, pa.int64())], ["query_id", "doc_id", "score"])

    return run
