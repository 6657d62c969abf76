"""Keyword search and the vector index against plain versions."""

from __future__ import annotations

import math
import random
import time
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relayloom.operators import corpus, matching, search, vector_index
from relayloom.plans import queries as plans

SCHEMA = "doc_id long, title string, text string, keywords array<string>, category string"


def plain_scores(queries, docs):
    out = {}
    for i, q, wanted in queries:
        q = (q or "").lower()
        for d, title, text, keywords, category in docs:
            if not q.strip() or (wanted is not None and wanted != category):
                continue
            title, text = (title or "").lower(), (text or "").lower()
            points = 10 * (q in title) + 2 * text.count(q) + sum(w in text for w in q.split())
            points += sum(5 * (x.lower() in q or q in x.lower()) for x in keywords or [])
            if points:
                out[i, d] = points
    return out


def some_texts(seed, n_docs, n_queries):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 4)))
    say = lambda n: " ".join(word() for _ in range(r.randrange(n)))
    docs = [(i, r.choice([None, say(4)]), r.choice([None, "", say(60)]), r.choice([None, [], [word() for _ in range(3)], ["", "aa"]]), r.choice(["x", "y", None])) for i in range(n_docs)]
    queries = [(i, r.choice([say(5), say(2), "a a", "AA", "aaa"]), r.choice([None, "x", "y", "z"])) for i in range(n_queries)]
    return docs, queries


@pytest.mark.parametrize("most", [None, 7])
def test_keyword_scores_are_the_plain_ones(spark, monkeypatch, most):
    docs, queries = some_texts(5, 60, 40)
    if most:
        monkeypatch.setattr(search, "QUERY_BLOCK", most)
    got = search.keyword_search(spark.createDataFrame(queries, "query_id long, query string, category string"), spark.createDataFrame(docs, SCHEMA).repartition(3), 4)
    want = plain_scores(queries, docs)
    best = {(i, d, s, n + 1) for i, *_ in queries for n, (s, d) in enumerate(sorted(((s, d) for (q, d), s in want.items() if q == i), key=lambda x: (-x[0], x[1]))[:4])}
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()} == best and len(best) > 80


def test_keyword_search_of_nothing(spark):
    docs, queries = some_texts(6, 5, 5)
    d, q = spark.createDataFrame([*docs, (None, "a", "a", [], "x")], SCHEMA), spark.createDataFrame(queries, "query_id long, query string, category string")
    assert search.keyword_search(q.where("false"), d).count() == 0 == search.keyword_search(q, d.where("false")).count()
    assert search.keyword_search(q, d).where("doc_id is null").count() == 0


def test_keywords_of_a_text_are_the_operator_s(spark):
    texts = ["Alpha beta beta the a1 x_y gamma", "", "éa abc ABC abcé zeta-zeta", "one " * 3 + "two " * 3 + "three"]
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    want = {r.id: r.keywords for r in corpus.keywords(d).collect()}
    assert {str(i): matching.frequent_words(t.lower()) for i, t in enumerate(texts) if want.get(str(i))} == want


def test_queries_that_match_nothing_cost_nothing():
    r = random.Random(2)
    word = lambda letters: "".join(r.choice(letters) for _ in range(6))
    texts = [" ".join(word("abcdef") for _ in range(200)) for _ in range(150)]

    def took(n):
        index = matching.QueryIndex([" ".join(word("uvwxyz") for _ in range(8)) for _ in range(n)] + [texts[0][:40]], [None] * (n + 1))
        best, began = matching.Best(n + 1, 5), time.process_time()
        for i, t in enumerate(texts):
            best.offer(*index.scores("", t, [], None), i)
        assert len(best.heaps) == 1
        return time.process_time() - began

    assert min(took(5_000) for _ in range(3)) < 3 * min(took(200) for _ in range(3)) + 0.05


# --- the vector index


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "doc_id long, vector array<float>").repartition(3)


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


@pytest.mark.parametrize("clumped", [True, False])
def test_recall_of_the_index(spark, tmp_path, clumped):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(1500, 12)) * (0.3 if clumped else 1) + (rng.normal(size=(25, 12)) * 3)[rng.integers(0, 25, 1500)] * clumped
    v, path = frame(spark, m), str(tmp_path / "ix")
    q = v.where("doc_id % 15 = 0").withColumnRenamed("doc_id", "query_id")
    vector_index.build_index(v, path, parts=4, sample=600)
    got, exact = vector_index.index_search(q, path, 10), search.vector_search(q, v, 10)
    assert len(pairs(got) & pairs(exact)) >= 0.95 * 1000 and got.count() == 1000
    probes = spark.read.parquet(f"{path}/model").first().probes
    assert probes <= 6 if clumped else probes > 6  # lists are read as the data need it
    distances = {(r.query_id, r.doc_id): r.distance for r in exact.collect()}
    assert all(abs(r.distance - distances[r.query_id, r.doc_id]) < 1e-5 for r in got.collect() if (r.query_id, r.doc_id) in distances)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "dynamicpruning" in plan


def test_all_lists_and_codes_are_exact(spark, tmp_path):
    m = np.random.default_rng(5).integers(-3, 4, (400, 5))
    v, path = frame(spark, m), str(tmp_path / "ix")
    vector_index.build_index(v, path, lists=7, parts=2, sample=100)
    q = v.withColumnRenamed("doc_id", "query_id")
    assert pairs(vector_index.index_search(q, path, 4, probes=7, again=300)) == pairs(search.vector_search(q, v, 4))


def test_index_of_awkward_rows(spark, tmp_path):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(9000, [5.0, 5.0, 5.0]), (9000, [5.0, 5.0, 5.0]), (None, [1.0] * 3), (1, None), (2, [1.0, None, 2.0]), (3, [float("nan")] * 3)]
    v, path = spark.createDataFrame(rows, "doc_id long, vector array<double>"), str(tmp_path / "ix")
    vector_index.build_index(v, path, lists=5, parts=3)
    stored = spark.read.parquet(f"{path}/lists")
    assert stored.select(F.sum(F.size("ids"))).first()[0] == 3002 and stored.select(F.max(F.size("ids"))).first()[0] <= vector_index.BLOCK
    q = v.where("doc_id in (0, 9000) or doc_id is null").distinct().withColumnRenamed("doc_id", "query_id")
    got = sorted((r.query_id, r.doc_id, r.distance) for r in vector_index.index_search(q, path, 2).collect())
    assert got == [(0, 0, 0.0), (0, 1, 0.0), (9000, 9000, 0.0), (9000, 9000, 0.0)]
    none = str(tmp_path / "none")
    vector_index.build_index(v.where("false"), none)
    assert vector_index.index_search(q, none).count() == 0 == vector_index.index_search(q.where("false"), path).count()


def test_code_tables_bound_what_they_stand_for():
    rng = np.random.default_rng(6)
    m = rng.normal(size=(300, 10))
    model = vector_index.Model(vector_index.centers(m, 4), np.stack([vector_index.centers(rng.normal(size=(300, 3)), 16) for _ in range(4)]))
    residuals = m - model.centroids[model.nearest_lists(m, 1)[:, 0]]
    codes, table = model.codes(residuals), model.table(residuals[:5])
    for p in range(4):
        assert (table[np.arange(5), p, codes[:5, p]] == table[:, p].min(axis=1)).all()
    assert pa.array([model.row()[2]]).to_pylist() == [10]


# --- all pairs


def in_order(a, b, digits=6):
    """What DuckDB's list_cosine_similarity and round do; 0 where a norm is 0."""
    if a is None or b is None or None in a or None in b or len(a) != len(b):
        return None
    added = lambda p, q: reduce(lambda s, uv: s + uv[0] * uv[1], zip(p, q, strict=True), 0.0)  # noqa: E731  (sum() would compensate)
    dot, x, y = added(a, b), added(a, a), added(b, b)
    if x == 0 or y == 0:
        return 0.0
    s = dot / math.sqrt(x * y) * 10**digits
    return s if math.isnan(s) else math.copysign(math.floor(abs(s)) + (abs(s) % 1 >= 0.5), s) / 10**digits


@pytest.mark.parametrize("most", [None, 40])
def test_cosines_are_the_sums_in_order(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(search, "QUERY_BLOCK", most)
        monkeypatch.setattr(search, "PAIRS", 7)
    rng = np.random.default_rng(7)
    e1, nan = [1.0] + [0.0] * 15, float("nan")
    odd = [None, [], [1.0, None], [1.0, nan] + [0.0] * 14, [0.0] * 16, [1.0] * 3, e1, [1.0] * 16, [-1.0] * 16, [3.0, 4.0], [1e30] * 16, [float("inf")] + [1.0] * 15]
    rows = [(i, v) for i, v in enumerate(odd + rng.normal(size=(40, 16)).tolist() + rng.integers(-2, 3, (40, 16)).astype(float).tolist())] + [(None, e1), (7, e1)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    q = v.where("doc_id is not null").withColumnRenamed("doc_id", "query_id")
    for digits in (1, 6):
        got = search.cosines(q, v, digits).collect()
        want = [(i, d, in_order(a, b, digits)) for i, a in rows if i is not None for d, b in rows]
        assert sorted(map(str, ((r.query_id, r.doc_id, r.similarity) for r in got))) == sorted(map(str, want))
    quarter = {r.doc_id: r.similarity for r in search.cosines(q.where("query_id = 6"), v, 1).collect()}
    assert quarter[8] == -0.3 and quarter[7] in (0.3, 1.0)  # halves away from 0
    assert search.cosines(q.where("false"), v).count() == 0 == search.cosines(q, v.where("false")).count()


def test_cosine_query_deals_one_file_evenly_and_works_in_blocks(spark, tmp_path):
    m = np.random.default_rng(8).normal(size=(20_000, 64)).astype(np.float32)
    spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(m))), "embedding": pa.array(list(m), pa.list_(pa.float32()))})).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = plans.QUERIES["f2_cosine"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 1 and "NestedLoop" not in got._jdf.queryExecution().toString()
    began = time.time()
    assert got.agg(F.count("similarity")).first()[0] == 4_000_000
    assert time.time() - began < 20  # 4 cores; pair by pair it takes minutes
    some = {(r.vec_id, r.other_id): r.similarity for r in got.where("vec_id % 4999 = 0 and other_id < 1000").collect()}
    assert len(some) == 50 and some == {(i, j): in_order(m[i].astype(float).tolist(), m[j].astype(float).tolist()) for i, j in some}
