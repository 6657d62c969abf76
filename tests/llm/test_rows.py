"""Awkward rows through every corpus operator and stage: null ids, null and empty texts, repeated rows, a very long text, clashing names, empty tables."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from relayloom.llm import decontaminate, fingerprints, lines, near, packing, pii, repeats, token_store, toxicity, warc

PLAIN = "a plain text of some words that is written once only, mail me@corp.org or not"
ROWS = [(1, PLAIN), (1, PLAIN), (None, PLAIN), (None, None), (2, None), (3, ""), (5, "stupid fools all of them")]
LONG = (4, "word%d long line of a very long text\n")
NAMES = "lang string, n_lines long, bucket long, row string, key string, words string, `a``b` string, text_hash string, block int"


@pytest.fixture(scope="module")
def docs(spark):
    long_text = "".join(LONG[1] % i for i in range(130_000))  # 5 MB
    rows = [(i, t, "x", 1, 2, "y", "k", "w", "b", "h", 7) for i, t in [*ROWS, (4, long_text)]]
    return spark.createDataFrame(rows, f"doc_id long, text string, {NAMES}").repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    return spark.createDataFrame([(i, i % 2) for i in ids] + [(None, 1)], "doc_id long, toxic int")


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


EVERY = sorted([(False, 1), (False, 1), (True, 0), (True, 0), (False, 2), (False, 3), (False, 4), (False, 5)])


def test_lines(docs):
    done = lines.dedup_lines(docs)
    assert ids(done) == EVERY and set(docs.columns) - {"n_lines"} <= set(done.columns) and lines.dedup_lines(docs.where("false")).count() == 0
    assert {(r.n_lines, r.n_dropped) for r in done.where("text is null or text = ''").collect()} == {(1, 0)}


def test_repeats(docs):
    done = repeats.remove_repeats(docs)
    assert ids(done) == EVERY and repeats.remove_repeats(docs.where("false")).count() == 0


def test_equal_ids_of_different_texts(spark):
    say = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, say(60, "a")), (1, say(5, "b")), (2, say(60, "a")), (None, say(60, "a")), (3, say(200, "c") + " " + say(40, "d")), (3, say(36, "e")), (4, say(9, "f") + " " + say(40, "d"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.remove_repeats(d).collect())
    assert got == [(0, 60, 0), (1, 5, 0), (1, 60, 60), (2, 60, 60), (3, 36, 0), (3, 240, 40), (4, 49, 40)]
    assert lines.dedup_lines(d).count() == 7 and near.near_groups(d).count() == 5


def test_near(docs):
    got = near.near_groups(docs)
    assert ids(got) == sorted([(False, 1), (True, 0), (True, 0), (False, 2), (False, 3), (False, 4), (False, 5)])
    assert all(r.kept and r.component_id is None for r in got.where("doc_id is null").collect())
    assert ids(near.drop_near_duplicates(docs)) == EVERY and near.drop_near_duplicates(docs.where("false")).columns == docs.columns


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "stupid fools all"), (None, None)], "item_id long, text string")
    got = decontaminate.contamination(docs, items)
    assert ids(got) == EVERY and {r.doc_id for r in got.where("contaminated").collect()} == {5}
    clean = decontaminate.drop_contaminated(docs, items)
    assert ids(clean) == [x for x in EVERY if x != (False, 5)] and clean.columns == docs.columns
    assert decontaminate.contamination(docs.where("false"), items).count() == 0


def test_pii(docs):
    got = pii.sanitise(docs)
    assert ids(got) == EVERY and pii.sanitise(docs.where("false")).count() == 0
    assert {len(r.base) for r in got.where("doc_id = 1 or (doc_id is null and size(base) > 0)").collect()} == {1}


def test_toxicity(docs, labels):
    assert ids(toxicity.toxicity(docs, labels)) == EVERY and ids(toxicity.drop_toxic(docs, labels.where("false"))) == EVERY
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0 and toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_fingerprints(docs):
    got = fingerprints.neighbour_fingerprints(docs, blocks=3)
    assert ids(got) == EVERY and fingerprints.fingerprint(docs).count() == len(EVERY)
    assert {r.fingerprint for r in got.where("n_chars = 0").collect()} == {""}


def test_tokens(docs, tokenizer):
    got = token_store.token_store(docs, tokenizer, end_id=0)
    assert ids(got) == EVERY and {r.n_tokens for r in got.where("doc_id in (2, 3)").collect()} == {1}
    assert token_store.token_store(docs.where("false"), tokenizer, end_id=0).count() == 0
    packed = packing.pack(docs, tokenizer)
    assert packed.agg(F.sum("length").alias("n")).first().n == got.agg(F.sum("n_tokens").alias("n")).first().n
    assert packing.pack(docs.where("false"), tokenizer).count() == 0


def test_warc(docs):
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit(None).cast("string"))
    got = warc.archive_round_trip(pages).withColumnRenamed("page_id", "doc_id")
    assert ids(got) == EVERY and warc.archive_round_trip(pages.where("false")).count() == 0


def test_stages_of_the_pipeline(spark, docs, labels, tmp_path):
    """Odd and clashing columns, the operators' own result names among them, go through all five stages unchanged."""
    import corpus_pipeline

    docs = docs.withColumns({"n_dropped": F.lit(8), "kept_text": F.lit("mine"), "kept": F.lit("k"), "contaminated": F.lit("c"), "score": F.lit(3), "n_chars": F.lit(-1).cast("long")})
    docs = docs.select("*", F.lit("dotted").alias("a.b"))
    labels.where("false").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    values = lambda df: {tuple(r[c] for c in own) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        assert ids(got) == EVERY and values(got) == values(docs), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 6
