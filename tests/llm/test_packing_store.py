"""op1 and op7 against the tokenizers library, on awkward texts."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relayloom.llm import near, packing, token_store, tokens, toxicity
from relayloom.llm.common import scratch
from relayloom.llm.tokens import Encoder

TEXTS = [None, "", " ", "  ", "a  b", "a   b", "x\n y", "x \n y", "\n \n", "it's we'll  ", "naïve 中文 ☃ 12 345", "tab\t x", "end ", "a  b", "<|endoftext|> is text", "word " * 3000, "q" * 5000, "same text twice", "same text twice"]


def ids_of(texts, path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, start long, part string").repartition(3)


def test_encoder_is_the_library(tokenizer):
    random.seed(5)
    texts = [t or "" for t in TEXTS] + ["".join(random.choice(" \n\tabé1.'’ ") for _ in range(random.randrange(40))) for _ in range(3000)]
    own = [np.frombuffer(b, "<u4").tolist() for b in Encoder(tokenizer).encode(texts)]
    assert own == ids_of(texts, tokenizer)


def test_token_store_round_trip(spark, tokenizer):
    rows = {r.doc_id: r for r in token_store.token_store(frame(spark, TEXTS), tokenizer).collect()}
    at = 0
    for i, ids in enumerate(ids_of(TEXTS, tokenizer)):
        raw = np.array([*ids, 0], "<u4").tobytes()
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids) + 1, zlib.crc32(raw))
        at += len(ids) + 1


def test_one_document_alone(spark, tokenizer):
    path = scratch(spark, "store")
    token_store.write_store(frame(spark, TEXTS * 5), path, tokenizer, shard_docs=4)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.read_documents(spark, path, [3, 40, 10_000]).collect()}
    want = ids_of(TEXTS * 5, tokenizer)
    assert got == {3: [*want[3], 0], 40: [*want[40], 0]}


def test_empty_store(spark, tokenizer):
    assert token_store.token_store(frame(spark, TEXTS).where("false"), tokenizer).count() == 0


@pytest.mark.parametrize("fan_in", [2, 256])
def test_packing_covers_every_id_once(spark, tokenizer, fan_in):
    texts = TEXTS + [" ".join(["word"] * (37 * i % 900)) for i in range(60)]
    out = packing.pack(frame(spark, texts).repartition(7), tokenizer, size=512, fan_in=fan_in).orderBy("doc_id", "start").toPandas()
    for i, ids in enumerate(ids_of(texts, tokenizer)):
        all_ids, mine, at = np.array([*ids, 1], "<u4"), out[out.doc_id == i], 0
        for r in mine.itertuples():
            assert r.start == at and r.doc_tokens == len(all_ids) and r.ids_crc32 == zlib.crc32(all_ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(all_ids)
    out = out.sort_values(["sequence_id", "offset"])
    by = out.groupby("sequence_id")
    assert (out.offset == by.length.cumsum() - out.length).all()
    used = by.length.sum()
    assert (used <= 512).all() and (used < 512).sum() <= 1


def test_packing_nothing(spark, tokenizer):
    assert packing.pack(frame(spark, TEXTS).where(F.lit(False)), tokenizer).count() == 0


def test_other_operators_forget_words(monkeypatch):
    """A worker that packed texts and goes on to score or sketch others keeps none of the words in memory, and encodes as before."""
    import public_tokenizers

    monkeypatch.setattr(tokens, "_ENCODERS", {})
    e = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words, and more of them"]})
    for task in (toxicity._trigrams, near._sketched(5, 42, 6)):
        ids = e.encode([" a few words, here."])
        e.known.old = {"kept": b""}
        assert e.known and e.parts
        assert list(task(iter([rows])))
        assert not (e.known or e.known.old or e.parts or e.parts.old) and e.encode([" a few words, here."]) == ids
