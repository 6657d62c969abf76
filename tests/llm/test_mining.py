"""Resampling, prefix BPE and hard negatives against plain versions and the tokenizers library."""

from __future__ import annotations

import hashlib
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from relayloom.llm import bpe, negatives, resample  # noqa: E402
from relayloom.llm.queries import tokenizer_path  # noqa: E402

DOCS = brute.corpus()
CLASHING = "lang string, n long, bucket int, score long, rank int, `a``b` string, s double, part int, cell int"
MORE = ("x", 1, 2, 3, 4, "y", 0.5, 6, 7)
ROWS = [(1, "some plain words"), (1, "some plain words"), (None, "some plain words"), (None, None), (2, None), (3, ""), (4, " \n")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], f"doc_id long, text string, {CLASHING}").repartition(3)


# --- resampling


def runs(text, most=3):
    w = brute.PLAIN.findall(brute.low(text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, targets, percent, least, buckets):
    got = {i: runs(t) for i, t in docs}
    s = Counter(c % buckets for _, found in got.values() for c in found)
    t = Counter(c % buckets for text in targets for c in runs(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (n_s + buckets)) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = {}
    for i, (n, found) in got.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % buckets] for c in found)
        out[i] = [n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    order = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    drawn = {i: at + 1 for at, i in enumerate(order[: percent * len(order) // 100])}
    return {i: (*x, drawn.get(i)) for i, x in out.items()}


@pytest.mark.parametrize(("percent", "least", "buckets"), [(40, 20, 97), (5, 1, 10_000)])
def test_resample(spark, percent, least, buckets):
    targets = [DOCS[12][1], None, "é one two"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    got = resample.resample(frame(spark, DOCS), items, percent=percent, least_words=least, buckets=buckets)
    assert {r.doc_id: (r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got.collect()} == plain_resample(DOCS, targets, percent, least, buckets)


def test_resample_awkward_rows(spark):
    docs, none = frame(spark, ROWS), spark.createDataFrame([], "item_id long, text string")
    got = resample.resample(docs, none, percent=100, least_words=3).collect()
    assert len(got) == len(ROWS) and {(r.n_features, r.weight, r.rank) for r in got if not r.n_words} == {(0, 0, None)}
    drawn = sorted((r.rank, r.doc_id) for r in got if r.rank)
    assert [r for r, _ in drawn] == [1, 2, 3] and {i for _, i in drawn} == {1, None}
    assert resample.resample(docs.where("false"), none).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, 5 - i % 2) for i in range(1, 41)], "doc_id long, score long").repartition(4)
    got = {r.doc_id: r.rank for r in resample.ranked(scored, 60, F.lit(True)).collect()}
    order = sorted(got, key=lambda i: (i % 2, i))
    assert [got[i] for i in order] == [*range(1, 25), *[None] * 16]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet=st.sampled_from("ab9éß日"), min_size=1, max_size=90), max_size=6), max_size=6))
def test_run_hashes(texts):
    splitter = resample.Splitter(1 << 31, 3)
    got = [(found[inside]).tolist() for found, inside in splitter.features(texts)]
    want = [[zlib.crc32(" ".join(w[i : i + n]).encode()) % (1 << 31) for w in texts for i in range(len(w) - n + 1)] for n in (1, 2, 3)]
    assert got == want[: len(got)] and not any(want[len(got) :])


def test_long_texts_are_cut_at_spaces(monkeypatch):
    text = " ".join(t or "" for _, t in DOCS)
    whole = resample.Splitter(10, 3).words(text)
    monkeypatch.setattr(resample, "PART", 50)
    assert resample.Splitter(10, 3).words(text) == whole == brute.PLAIN.findall(brute.low(text))


# --- prefix BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.Codec(tokenizer_path("word_bpe_49k.json"))


def encoded(coder, text):
    return np.frombuffer(coder.encode([text])[0], dtype=np.uint32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeiloust'r TH.,!?-\n\té́İσςΣ日👍🏽<|>"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_ids_of_the_library(coder, text):
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    ids = encoded(coder, text)
    assert ids == want
    said = coder.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist()
    assert said == [coder.tokenizer.decode(want, skip_special_tokens=False)]


@pytest.mark.parametrize("text", ["", "  ", "a<|endoftext|>b", "<|startoftext|><|startoftext|>", "<|ENDOFTEXT|>", "a" * 3000, "abab" * 999 + "c", "x   y\x85z w", "don't we'll I'M", "́ ́x"])
def test_ids_of_odd_texts(coder, text):
    assert encoded(coder, text) == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_compatible_tokens_are_those_that_merging_leaves():
    vocab = {x: i for i, x in enumerate(["a", "b", "c", "ab", "bc", "aa", "abc", "aab"])}
    coder = bpe.PrefixCoder({"vocab": vocab, "merges": [("b", "c"), ("a", "b"), ("a", "a"), ("a", "bc"), ("aa", "b")]})
    ranks = {("b", "c"): 0, ("a", "b"): 1, ("a", "a"): 2, ("a", "bc"): 3, ("aa", "b"): 4}
    r = random.Random(3)
    for _ in range(300):
        word = list("".join(r.choice("abc") for _ in range(r.randrange(1, 12))))
        text = "".join(word)
        while (pairs := [(ranks[p], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks]):
            i = min(pairs)[1]
            word[i : i + 2] = [word[i] + word[i + 1]]
        assert coder.encode(text) == [vocab[w] for w in word]


def test_unfit_vocabularies_are_refused():
    with pytest.raises(ValueError, match="made later"):
        bpe.Merges({"a": 0, "aa": 1, "aaa": 2}, [("aa", "a"), ("a", "a")])
    with pytest.raises(ValueError, match="no token"):
        bpe.PrefixCoder({"vocab": {"a": 0}, "merges": []}).encode("ab")


def test_encode_decode(spark, coder):
    rows = [*ROWS, *DOCS, (5, "word%d and more\n" * 100_000)]
    got = bpe.encode_decode(frame(spark, rows), tokenizer_path("word_bpe_49k.json")).collect()
    want = []
    for i, t in rows:
        e = coder.tokenizer.encode(t or "", add_special_tokens=False)
        want.append((i, e.ids, coder.tokenizer.decode(e.ids, skip_special_tokens=False)))
    by = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=by) == sorted(want, key=by)
    assert bpe.encode_decode(frame(spark, ROWS).where("false"), tokenizer_path("word_bpe_49k.json")).count() == 0


# --- hard negatives


def plain_negatives(rows, every, n_pos=5, n_neg=10, least=30, most=90, scale=256):
    fit = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, lab, va in fit:
        if a % every:
            continue
        scored = [(-dot(va, v), i, x) for i, x, v in fit]
        for s, p, _ in sorted(x for x in scored if x[2] == lab and x[1] != a)[:n_pos]:
            good = sorted(x for x in scored if x[2] != lab and least * -s <= -100 * x[0] <= most * -s)[:n_neg]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(good, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some_vectors(seed, n, dim, clumped):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    say = lambda c: [round(c[k] * clumped + r.gauss(0, 0.4), 1) for k in range(dim)]
    return [(i, say(centers[i % 5]), r.randrange(3) if i % 4 else 1) for i in range(n)]


@pytest.mark.parametrize(("dim", "clumped"), [(3, 0), (16, 1), (70, 0.5)])
def test_hard_negatives(spark, monkeypatch, dim, clumped):
    rows = some_vectors(dim, 230, dim, clumped)
    df = spark.createDataFrame([(*r, *MORE) for r in rows], f"vec_id long, embedding array<float>, label int, {CLASHING}").repartition(3)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    want = plain_negatives(rows, 10)
    assert found(negatives.hard_negatives(df, "id % 10 = 0")) == want and len(want) > 20
    for name, n in (("GROUP", 4), ("ROWS", 7), ("PAIRS", 5)):
        monkeypatch.setattr(negatives, name, n)
    assert found(negatives.hard_negatives(df, "id % 10 = 0")) == want


def test_hard_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.25, 9.0], 2), (3, [0.5], 2), (4, [], 2), (None, [1.0, 1.0], 1), (5, None, 1), (6, [1.0, None], 2), (7, [nan, 1.0], 2), (8, [inf, 0.0], 2), (9, [0.5, 0.2], None), (10, [-1.0, -1.0], 3), (20, [0.0, 0.0], 3), (11, [0.4, 0.4], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = found(negatives.hard_negatives(df, "id % 10 = 0"))
    assert got == plain_negatives([(r.vec_id, r.embedding, r.label) for r in df.collect()], 10) and len(got) > 4
    assert found(negatives.hard_negatives(df.where("false"), "id % 10 = 0")) == [] == found(negatives.hard_negatives(df, "false"))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(0, 10**6), st.booleans())
def test_summaries_bound_scores(dim, seed, shorter):
    r = np.random.default_rng(seed)
    make = lambda n, d: r.integers(-300, 300, (n, d)) * r.integers(0, 2, (n, 1))

    def side(m):
        means, deviations = negatives.summaries(m)
        lists = [pa.array(x.tolist(), pa.list_(t)) for x, t in ((m, pa.int64()), (means, pa.float64()), (deviations, pa.float64()))]
        plain = [pa.array(np.arange(len(m)), pa.int64())] * 2 + [pa.array(np.zeros(len(m)), pa.int64())]
        return negatives.Side.of(pa.RecordBatch.from_arrays([*plain, *lists], ["no", "id", "label", "vector", "means", "deviations"]))

    a, b = make(9, dim), make(7, max(1, dim // 3) if shorter else dim)
    exact = a[:, : b.shape[1]] @ b.T
    least, most = np.full(9, -1000), np.full(9, 20_000)
    got = {(i, j): s for x in negatives.candidates(side(a), side(b), least, most, False) for i, j, s in zip(*x, strict=True)}
    assert all(got[i, j] == exact[i, j] for i in range(9) for j in range(7) if -1000 <= exact[i, j] <= 20_000)
