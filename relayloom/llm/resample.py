"""Target-distribution importance resampling of documents.

Texts are cut by the tokenizers library's Split pre-tokenizer, an untrained regular expression, after A-Z became a-z.
Every run of one to three consecutive words is a feature; its bucket is the CRC-32 of the words joined by one space.
Histograms of buckets over all documents and over all target texts give each bucket a gain, the scaled log ratio of its
two shares, and a document's weight is the sum of gains over its features.  Adding Gumbel noise that depends on the id
alone and taking the largest scores draws documents without replacement, likelier the larger their weight.

Null texts have no words, and so no features, weight 0 and no draw.  A null id has the noise of an empty one and comes
after equal scores with an id.  Repeated rows are documents of their own with equal scores, and each gets a rank.
Without documents nothing is drawn; without targets the gains compare with an empty histogram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayloom.llm.common import documents, pieces, written

#: What a word is, for the pre-tokenizer, in texts whose A-Z are a-z.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters of a text that the pre-tokenizer gets at once, up to a space.
PART = 1 << 17
#: Bytes of text whose words a task holds at once.
PIECE = 1 << 20
#: Bytes over which a CRC is moved by table; longer runs are read by zlib.
LONGEST = 64


def _moves() -> np.ndarray:
    """At [n, k, b], flat: what byte k of a CRC, of the value b, becomes when n zero bytes follow."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    out = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(LONGEST):
        out.append((out[-1] >> np.uint32(8)) ^ step[out[-1] & np.uint32(255)])
    return np.stack(out).ravel()


class Splitter:
    """The words of texts, and the buckets of their features."""

    def __init__(self, buckets: int, most_words: int):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True).pre_tokenize_str
        self.buckets, self.most_words, self.moves = np.uint32(buckets), most_words, _moves()

    def words(self, text: str) -> list[str]:
        text = text.encode().lower().decode()  # of bytes, this lowers A-Z alone
        out: list[str] = []
        at = 0
        while at < len(text):
            to = text.find(" ", at + PART)
            to = len(text) if to < 0 else to
            out += [w for w, _ in self.split(text[at:to])]
            at = to
        return out

    def moved(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRCs after ``size`` zero bytes more."""
        at, low = np.minimum(size, LONGEST) << 10, np.uint32(255)
        out = self.moves[at + (crc & low)]
        for k in (1, 2, 3):
            out ^= self.moves[at + ((crc >> np.uint32(8 * k) & low) + np.uint32(256 * k))]
        return out

    def features(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1, 2, ... words: the bucket of the run at each word, and whether it ends in the word's own text.

        A run is a pair of offsets, the begin of its first word and the end of its last, into all words joined by one
        space.  As a CRC is linear, that of a run and one word more is the run's, moved, and that of the space and word.
        """
        words = [w for text in texts for w in text]
        if not words:
            return
        text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        joined = " ".join(words).encode()
        gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        begin, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
        size = end - begin
        run = np.fromiter(map(zlib.crc32, joined.split(b" ")), dtype=np.uint32, count=len(words))
        after = self.moved(np.full(len(words), zlib.crc32(b" "), dtype=np.uint32), size) ^ run
        yield run % self.buckets, np.ones(len(words), dtype=bool)
        for n in range(2, min(self.most_words, len(words)) + 1):
            run = self.moved(run[:-1], size[n - 1 :] + 1) ^ after[n - 1 :]
            for i in np.flatnonzero(size[n - 1 :] >= LONGEST).tolist():
                run[i] = zlib.crc32(joined[begin[i] : end[i + n - 1]])
            yield run % self.buckets, text[n - 1 :] == text[: 1 - n]


def histogram(texts: DataFrame, buckets: int = 10_000, most_words: int = 3) -> DataFrame:
    """(bucket, n) of all features of (text): summed in each task, so that a task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, total = Splitter(buckets, most_words), np.zeros(buckets, dtype=np.int64)
        for batch in pieces(batches, "text", most=PIECE):
            for found, inside in splitter.features([splitter.words(t or "") for t in batch.column("text").to_pylist()]):
                total += np.bincount(found[inside], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000, scale: int = 1000) -> list[int]:
    """Each bucket's floor(scale * ln(share in the target / share in the source)), with one feature more in every bucket."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full_outer")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    rows = both.collect()  # a row a bucket
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64).tolist()


def weights(docs: DataFrame, of: list[int], most_words: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document; ``of`` has each bucket's gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, gain = Splitter(len(of), most_words), np.array(of, dtype=np.int64)
        for batch in pieces(batches, "text", most=PIECE):
            texts = [splitter.words(t) for t in batch.column("text").to_pylist()]
            first = np.cumsum([0, *map(len, texts)])
            n_features, weight = np.zeros((2, len(texts)), dtype=np.int64)
            for found, inside in splitter.features(texts):
                for out, each in ((n_features, inside), (weight, np.where(inside, gain[found], 0))):
                    sums = np.concatenate([[0], np.cumsum(each)])[np.minimum(first, len(each))]
                    out += np.diff(sums)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 42, scale: int = 1000) -> Column:
    """Noise of an id: floor(-scale * ln(-ln(u))), u from the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int, eligible: Column) -> DataFrame:
    """Adds rank, 1, 2, ... by descending score and then id, to the first ``percent`` of the eligible rows; null to the others.

    One range shuffle sorts the eligible rows; a row's rank is its place in its partition and the rows of the partitions
    before it, a sum over one row a partition.  No task sees more than its range.
    """
    spark = scored.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    order = written(scored.where(eligible).repartitionByRange(n, *best).sortWithinPartitions(*best).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", 33)
    parts = order.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    parts = parts.select("_part", (F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    placed = order.withColumn("_part", part).join(F.broadcast(parts), "_part")  # parts: a row a range partition
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    placed = placed.withColumn("rank", F.when(place <= F.floor(F.lit(percent) * F.col("_all") / 100), place))
    rest = scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*scored.columns, "rank").unionByName(rest)


def resample(docs: DataFrame, targets: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, most_words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each document; rank is null unless it is drawn.

    Of the documents with ``least_words`` words or more, ``percent`` are drawn.  The texts are read twice, once for the
    histogram and once for the weights; between the two the driver holds one number a bucket.
    """
    of = gains(histogram(docs, buckets, most_words), histogram(targets, buckets, most_words), buckets)
    scored = written(weights(docs, of, most_words).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    return ranked(scored, percent, F.col("n_words") >= least_words)
