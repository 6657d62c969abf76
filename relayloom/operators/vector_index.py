"""An inverted-file index of vectors with product-quantized residuals, kept as a partitioned table.

Coarse centroids cut the space into lists.  A vector is stored in the list of its nearest centroid, as a code: what it
differs from the centroid by is cut to parts, and each part is the number of the nearest entry of that part's code book.
A query goes to the lists of its nearest centroids by an equi-join.  There the distances to all codes come from one small
table of distances to code book entries; the best of them are measured again with the vectors themselves.

Centroids and code books are fitted on a bounded sample, the rows of least hash of id; every vector is indexed.  On the
same sample the build finds out how many lists must be read for a wished recall, and keeps that number: few where vectors
stand in clumps, more where they fill the space evenly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayloom.operators.search import top_k

#: Vectors of a list that stand in one row, queries of a list that meet them at once.
BLOCK, ASKED = 1024, 256
MOST_LISTS = 2048
INDEX = "list int, ids array<long>, codes binary, vectors binary"
MODEL = "centroids binary, books binary, dim int, lists int, parts int, entries int, probes int"
#: Sample rows that are asked, and neighbours of each, to find the number of lists to read.
TRIED, NEAREST = 256, 10


@dataclass
class Model:
    """Coarse centroids (lists x dim) and code books (parts x entries x dim / parts)."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.books)

    def padded(self, m: np.ndarray) -> np.ndarray:
        """Vectors cut to parts of equal length, zeros behind the last component."""
        width = self.books.shape[2]
        return np.pad(m, ((0, 0), (0, self.parts * width - m.shape[1]))).reshape(len(m), self.parts, width)

    def nearest_lists(self, m: np.ndarray, n: int) -> np.ndarray:
        d = squared(m, self.centroids)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        cut = self.padded(residuals)
        return np.stack([squared(cut[:, p], self.books[p]).argmin(axis=1) for p in range(self.parts)], axis=1).astype(np.uint8)

    def table(self, residuals: np.ndarray) -> np.ndarray:
        """[query, part, entry]: squared distances of each part to the entries of its book."""
        cut = self.padded(residuals)
        return np.stack([squared(cut[:, p], self.books[p]) for p in range(self.parts)], axis=1)

    def row(self) -> tuple:
        return (bytearray(self.centroids.tobytes()), bytearray(self.books.tobytes()), self.centroids.shape[1], len(self.centroids), *self.books.shape[:2], self.probes)

    @classmethod
    def of(cls, r) -> Model:
        return cls(np.frombuffer(bytes(r.centroids)).reshape(r.lists, r.dim), np.frombuffer(bytes(r.books)).reshape(r.parts, r.entries, -1), r.probes)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def centers(m: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k centers of the rows by Lloyd's rounds; an empty one moves to the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(m, axis=0)
    out = distinct[rng.permutation(len(distinct))[:k]]
    out = np.concatenate([out, np.zeros((k - len(out), m.shape[1]))]) if len(out) < k else out
    for _ in range(rounds):
        d = squared(m, out)
        of = d.argmin(axis=1)
        sums, n = np.zeros_like(out), np.bincount(of, minlength=k)
        np.add.at(sums, of, m)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
        empty = np.flatnonzero(n == 0)
        far = np.argsort(-d[np.arange(len(m)), of])[: len(empty)]
        out[empty[: len(far)]] = m[far]
    return out


def needed(m: np.ndarray, coarse: np.ndarray, recall: float) -> int:
    """How many of the nearest lists hold that share of the nearest neighbours of some rows, among all rows of ``m``."""
    asked = m[:: max(1, len(m) // TRIED)][:TRIED]
    near = np.argsort(squared(asked, m), axis=1, kind="stable")[:, : NEAREST + 1]  # the row itself is one
    home = squared(m, coarse).argmin(axis=1)[near]
    place = np.argsort(np.argsort(squared(asked, coarse), axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(place, home, axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def fit(vectors: DataFrame, lists: int, parts: int, sample: int, recall: float) -> Model:
    """Centroids, code books and probes by at most ``sample`` rows of (doc_id, vector)."""
    rows = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("vector").collect()  # a bounded sample
    m = np.array([r.vector for r in rows], dtype=np.float64)
    coarse = centers(m, min(lists, len(m)))
    model = Model(coarse, np.zeros((parts, min(256, len(m)), -(-m.shape[1] // parts))))
    cut = model.padded(m - coarse[squared(m, coarse).argmin(axis=1)])
    model.books = np.stack([centers(cut[:, p], model.books.shape[1], seed=p) for p in range(parts)])
    model.probes = needed(m, coarse, recall)
    return model


def whole(vectors: DataFrame) -> DataFrame:
    """Rows that can be indexed: with an id and a vector of numbers only."""
    return vectors.where(F.col("doc_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def build_index(vectors: DataFrame, path: str, lists: int | None = None, parts: int = 16, sample: int = 20_000, recall: float = 0.98) -> None:
    """Writes the index of (doc_id, vector) to ``path``: the model, and vectors by list in blocks of BLOCK rows.

    Without ``lists`` there are as many as the square root of the number of vectors, MOST_LISTS at most.

    ``rebalance`` brings a list together, or cuts it to several tasks if it is large; so a list that holds a third of
    all vectors takes more files, not more memory.  All vectors must have one length.
    """
    spark = vectors.sparkSession
    vectors = whole(vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector")))
    n = vectors.count()
    if not n:
        spark.createDataFrame([], MODEL).write.parquet(f"{path}/model")
        spark.createDataFrame([], INDEX).write.parquet(f"{path}/lists")
        return
    model = fit(vectors, lists or min(MOST_LISTS, int(n**0.5)), parts, sample, recall)
    spark.createDataFrame([model.row()], MODEL).coalesce(1).write.parquet(f"{path}/model")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)
                of = model.nearest_lists(m, 1)[:, 0]
                codes = model.codes(m - model.centroids[of])
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), batch.column("doc_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in m], pa.binary())], ["list", "doc_id", "code", "vector"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        number = None

        def row() -> pa.RecordBatch:
            ids, codes, raw = held
            return pa.RecordBatch.from_pylist([{"list": number, "ids": ids, "codes": b"".join(codes), "vectors": b"".join(raw)}], schema=pa.schema([("list", pa.int32()), ("ids", pa.list_(pa.int64())), ("codes", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            for of, *x in zip(*[batch.column(c).to_pylist() for c in ("list", "doc_id", "code", "vector")], strict=True):
                if held[0] and (of != number or len(held[0]) >= BLOCK):
                    yield row()
                    held = ([], [], [])
                number = of
                for into, value in zip(held, x, strict=True):
                    into.append(value)
        if held[0]:
            yield row()

    assigned = vectors.mapInArrow(assign, "list int, doc_id long, code binary, vector binary")
    together = assigned.hint("rebalance", "list").sortWithinPartitions("list", "doc_id")
    together.mapInArrow(block, INDEX).write.partitionBy("list").parquet(f"{path}/lists")


def index_search(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, again: int = 8) -> DataFrame:
    """(query_id, doc_id, distance, score, rank): about the k nearest vectors of each (query_id, vector), by squared distance.

    A query reads its ``probes`` nearest lists only, by default as many as the build found needed; of each block of a list, its ``again`` * k best codes are
    measured exactly.  Distances are exact; a vector is missed if its list is not read or its code misleads.
    With as many probes as lists and ``again`` over BLOCK / k, nothing is missed.
    """
    spark: SparkSession = queries.sparkSession
    found = "query_id long, doc_id long, distance double"
    rows = spark.read.schema(MODEL).parquet(f"{path}/model").collect()
    if not rows:
        return top_k(spark.createDataFrame([], found).withColumn("score", F.col("distance")), k)
    model = Model.of(rows[0])
    probes = probes or model.probes
    q = queries.select(F.col("query_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries by list, ASKED in a row."""
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                part = batch.slice(at, ASKED)
                ids, m = part.column("doc_id").to_numpy(), part.column("vector").flatten().to_numpy().reshape(part.num_rows, -1)
                near = model.nearest_lists(m, probes)
                for of in np.unique(near):
                    mine = np.flatnonzero((near == of).any(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([ids[mine].tolist()], pa.list_(pa.int64())), pa.array([m[mine].tobytes()], pa.binary())], ["list", "asked", "q"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, asked, raw, ids, codes, vectors in zip(*[batch.column(c).to_pylist() for c in ("list", "asked", "q", "ids", "codes", "vectors")], strict=True):
                m = np.frombuffer(raw).reshape(len(asked), -1)
                code = np.frombuffer(codes, dtype=np.uint8).reshape(len(ids), -1)
                known, key = np.frombuffer(vectors).reshape(len(ids), -1), np.array(ids)
                table = model.table(m - model.centroids[of])
                rough = sum(table[:, p, code[:, p]] for p in range(model.parts))
                n = min(len(ids), again * k)
                best = np.argsort(rough, axis=1, kind="stable")[:, :n]  # a block is in order of id, so ties go to the smaller
                exact = ((m[:, None, :] - known[best]) ** 2).sum(axis=2)
                order = np.lexsort((key[best], exact), axis=1)[:, :k]
                best, exact = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(asked), best.shape[1])), pa.array(key[best].ravel()), pa.array(exact.ravel())], ["query_id", "doc_id", "distance"])

    asked = whole(q).mapInArrow(probe, "list int, asked array<long>, q binary")
    lists = spark.read.schema(INDEX).parquet(f"{path}/lists")
    hits = asked.join(lists, "list").mapInArrow(measure, found)
    return top_k(hits.withColumn("score", 1 / (1 + F.col("distance"))), k)
