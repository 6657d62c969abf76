"""Token ids as compact binary shards with random access to short documents.

A store is a Parquet table with one row per shard.  A shard holds consecutive documents in
ascending ``doc_id`` order:

    part, seq      the shard's place: range partition, then number in it
    before         long         ids of the partition's documents before this shard
    dict_sha256    which dictionary its frames need
    doc_ids        array<long>
    n_tokens       array<int>   ids of each document, the end id included
    offsets        array<int>   n + 1 places in ``body``: document i is body[offsets[i]:offsets[i + 1]]
    body           binary       one zstandard frame a document, over its ids as little-endian
                                unsigned 16-bit integers (32-bit where the vocabulary needs it)

A second table beside it holds the dictionary.  Every frame is compressed alone with the shared
dictionary, so one document is read by slicing ``body`` and decompressing a few hundred bytes.

Nulls and empty texts are documents that hold just the end id.  Rows with equal ``doc_id`` are
kept as documents of their own, next to each other.  An empty table gives an empty store.
Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relayloom.llm.common import documents, pieces, scratch
from relayloom.llm.tokens import encoder

SHARD = "part int, seq int, before long, dict_sha256 string, doc_ids array<long>, n_tokens array<int>, offsets array<int>, body binary"
READ = "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, wide: bool, sample_docs: int = 2000, sample_ids: int = 2048, dict_bytes: int = 65536) -> bytes:
    """A zstandard dictionary of serialized id arrays.

    It is fitted on the first ``sample_ids`` ids of the ``sample_docs`` documents whose hashed
    ids are smallest: a bounded sample that does not depend on the order of rows.  The frames of
    all documents use it.  Too little data for a dictionary gives an empty one.
    """
    import zstandard

    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    some = docs.join(F.broadcast(chosen), "doc_id").select(F.substring("text", 1, 4 * sample_ids).alias("text"))  # sample_docs ids
    texts = [r.text for r in some.limit(sample_docs).collect()]
    kind = "<u4" if wide else "<u2"
    samples = [np.append(np.frombuffer(b, "<u4")[: sample_ids - 1], end_id).astype(kind).tobytes() for b in encoder(tokenizer).encode(texts)]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(dict_bytes, max(1024, sum(map(len, samples)) // 16)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=1, dict_data=d, write_checksum=False), zstandard.ZstdDecompressor(dict_data=d)


def _shards(tokenizer: str, end_id: int, wide: bool, dictionary: bytes, shard_bytes: int, shard_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    name = hashlib.sha256(dictionary).hexdigest()
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        enc, (compress, _) = encoder(tokenizer), _codec(dictionary)
        ids: list[int] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "dict_sha256": name, "doc_ids": ids, "n_tokens": counts, "offsets": offsets, "body": b"".join(frames)}], schema=schema)

        for batch in pieces(batches, "text"):
            keys = batch.column("doc_id").to_pylist()
            for key, raw in zip(keys, enc.encode(batch.column("text").to_pylist()), strict=True):
                raw += int(end_id).to_bytes(4, "little")
                counts.append(len(raw) // 4)
                frames.append(compress.compress(raw if wide else np.frombuffer(raw, "<u4").astype("<u2").tobytes()))
                ids.append(key)
                held += len(frames[-1])
                if held >= shard_bytes or len(ids) >= shard_docs:
                    yield shard()
                    seq, before, ids, counts, frames, held = seq + 1, before + sum(counts), [], [], [], 0
        if ids:
            yield shard()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, partitions: int | None = None, shard_bytes: int = 1 << 20, shard_docs: int = 2048, **sample: int) -> None:
    """Encodes ``docs`` and writes a store to ``path``: one range shuffle by ``doc_id``, then Python once a document."""
    spark = docs.sparkSession
    docs = documents(docs)
    wide = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
    dictionary = train_dictionary(docs, tokenizer, end_id, wide, **sample)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
        .mapInArrow(_shards(tokenizer, end_id, wide, dictionary, shard_bytes, shard_docs), SHARD)
        .write.option("compression", "none").parquet(f"{path}/shards")
    )
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary), wide)], "dict_sha256 string, dictionary binary, wide boolean").coalesce(1).write.parquet(f"{path}/dictionary")


def _decoder(dictionary: bytes, wide: bool, with_ids: bool):
    name = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decompress = _codec(dictionary)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != name:
                    raise ValueError(f"shard {row['part']}/{row['seq']} needs dictionary {row['dict_sha256']}")
                body, at, start, out = memoryview(row["body"]), row["offsets"], row["start"], []
                for key, n, a, b in zip(row["doc_ids"], row["n_tokens"], at, at[1:], strict=False):
                    raw = decompress.decompress(body[a:b], max_output_size=n * (4 if wide else 2))
                    raw = raw if wide else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    if len(raw) != 4 * n:
                        raise ValueError(f"document {key}: {len(raw) // 4} ids, {n} expected")
                    out.append((row["part"], row["seq"], key, start, n, zlib.crc32(raw), *((raw,) if with_ids else ())))
                    start += n
                names = ["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row a document in ``doc_id`` order of place: READ, and its ids as little-endian unsigned 32-bit bytes on request.

    ``start`` counts the ids of all documents before it: the shard's ``before`` plus the total of
    earlier partitions, a sum over one row a partition.  The shards themselves are not shuffled.
    """
    row = spark.read.parquet(f"{path}/dictionary").first()
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards")
    parts = shards.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("earlier"))
    placed = shards.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("earlier"))  # parts: a row a range partition
    return placed.mapInArrow(_decoder(bytes(row.dictionary), row.wide, with_ids), READ + (", ids binary" if with_ids else ""))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int], with_ids: bool = True) -> DataFrame:
    """Some documents alone: only shards that hold one of them are decoded (``start`` counts from the shard)."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    shards = spark.read.schema(SHARD).parquet(f"{path}/shards").where(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(i)) for i in doc_ids])))
    place = F.array_position
    wanted = shards.select("part", "seq", "dict_sha256", F.explode(F.array(*[F.lit(int(i)) for i in doc_ids])).alias("want"), "doc_ids", "n_tokens", "offsets", "body").where(F.array_contains("doc_ids", F.col("want")))
    one = wanted.withColumn("i", place("doc_ids", F.col("want"))).select(
        "part", "seq", "dict_sha256", F.array("want").alias("doc_ids"), F.array(F.element_at("n_tokens", F.col("i").cast("int"))).alias("n_tokens"),
        F.expr("array(0, offsets[i] - offsets[i - 1])").cast("array<int>").alias("offsets"), F.expr("substring(body, offsets[i - 1] + 1, offsets[i] - offsets[i - 1])").alias("body"), F.lit(0).cast("long").alias("start"),
    )
    return one.mapInArrow(_decoder(bytes(row.dictionary), row.wide, with_ids), READ + (", ids binary" if with_ids else ""))


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes a store of ``docs`` to the shared folder and returns its documents, read back."""
    path = scratch(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return read_store(docs.sparkSession, path)
