"""Document fingerprints, and how alike a document is to an edit of it and to its neighbour.

Words are runs without ASCII white space, A-Z lower-cased; shingles have five words (a shorter
text is one shingle).  A fingerprint is base64 of the packed sketch; a text without words has "".

The documents are put in blocks of descending ``doc_id``.  A block also gets the first document
of the block after it, so that each document meets its successor in one pass and texts are
shuffled once.  There is a block for every BLOCK_BYTES of text, at least; the cuts between them come from
quantiles of ``doc_id``, one number a block, and the blocks' first documents from a join with their ids.
Null ids come last; equal ids are ordered by text.  Null texts are empty.  A table of one document
is its own successor.  Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayloom.llm.common import documents, pieces, written
from relayloom.llm.sketch import flat_shingles, likeness, one_permutation, packed
from relayloom.llm.wordhash import words

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LEAST = -(1 << 63)
#: Bytes of text in a block, about.
BLOCK_BYTES = 32 << 20


def codes(texts: list[str], k: int, bins: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sketches of texts, and which of the texts have no words."""
    w = words(pa.array(texts, pa.large_string()))
    h, text = flat_shingles(w, k)
    return packed(one_permutation(h, text, len(texts), bins), bits), np.diff(w.first) == 0


def as_text(code: np.ndarray, empty: bool) -> str:
    return "" if empty else base64.b64encode(code.tobytes()).decode()


def fingerprint(docs: DataFrame, k: int = 5, bins: int = 1024, bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint), computed where the texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            code, empty = codes(batch.column("text").to_pylist(), k, bins, bits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([as_text(c, e) for c, e in zip(code, empty, strict=True)])], ["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _pairs(k: int, bins: int, bits: int):
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last row so far: block, extra, id, text, code, empty
        for batch in pieces(batches, "text", 1 << 20):
            block, extra, key = batch.column("block").to_pylist(), batch.column("extra").to_pylist(), batch.column("doc_id").to_pylist()
            text = batch.column("text").to_pylist()
            code, empty = codes(text, k, bins, bits)
            rows = list(zip(block, extra, key, text, code, empty, strict=True))
            rows = ([kept] if kept else []) + rows
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[1]]
            kept = rows[-1]
            if not pairs:
                continue
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            other, other_empty = codes(edited, k, bins, bits)
            own, nxt = np.stack([a[4] for a, _ in pairs]), np.stack([b[4] for _, b in pairs])
            own_empty, nxt_empty = np.array([a[5] for a, _ in pairs]), np.array([b[5] for _, b in pairs])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([as_text(c, e) for c, e in zip(own, own_empty, strict=True)]),
                    pa.array([as_text(c, e) for c, e in zip(other, other_empty, strict=True)]),
                    pa.array(likeness(own, other, own_empty, other_empty, bits)),
                    pa.array(likeness(own, nxt, own_empty, nxt_empty, bits)),
                ],
                names,
            )

    return run


def neighbour_fingerprints(docs: DataFrame, k: int = 5, bins: int = 1024, bits: int = 4, blocks: int | None = None) -> DataFrame:
    """RESULT rows.

    The edited text is the document with its last floor(n / 2) code points replaced by the first as
    many (or all) of the next document in descending ``doc_id`` order; after the last comes the first.
    """
    spark = docs.sparkSession
    docs = documents(docs).withColumn("key", F.coalesce("doc_id", F.lit(_LEAST)))
    if blocks is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        blocks = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    cuts = sorted(set(docs.approxQuantile("key", [i / blocks for i in range(1, blocks)], 0.1 / blocks)))
    edges = np.array(cuts)

    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="left"))

    docs = docs.withColumn("block", F.pandas_udf(find, "int")("key"))
    ends = docs.groupBy("block").agg(F.max("key").alias("key"))
    order = Window.orderBy("block")  # a row a block
    ends = ends.select("key", F.coalesce(F.lead("block").over(order), F.first("block").over(order)).alias("before"))
    ends = written(ends, "block-ends")  # ``blocks`` rows at most, so it may be broadcast
    extra = docs.join(F.broadcast(ends), "key").select("doc_id", "text", "key", F.col("before").alias("block"), F.lit(1).alias("extra"))
    both = docs.withColumn("extra", F.lit(0)).unionByName(extra)
    dealt = both.repartition(blocks, "block").sortWithinPartitions("block", "extra", F.desc("key"), "text")
    return dealt.select("block", "extra", "doc_id", "text").mapInArrow(_pairs(k, bins, bits), RESULT)
