"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.  A run is a table of
(h1, h2, n_docs, last_doc) sorted by hash: how many documents of some batches hold a key, and the
largest ``doc_id`` among them.  A new batch adds a run to level 0; ``fan`` runs of a level are
compacted to one of the next, so a key lies in few runs and old runs are rarely rewritten.  The
lines of a batch are then merge-anti-joined with the runs: what is left stays.

Keys are 128-bit hashes.  Null and empty texts have one empty line.  Rows with equal ``doc_id``
are documents of their own for the count; if theirs is the largest id, all of them keep the line.
So are rows without an id, told apart by their texts; any id is larger than none, and a line that
only such rows hold stays.
Input columns stay, but for those that the result names itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayloom.llm.common import documents, drop_folder, fewer, pieces, quoted, scratch, written

STRIPPED = b" \t\n\x0b\x0c\r"
LINES = "batch int, doc_id long, nameless string, h1 long, h2 long, places array<int>"
RUN = "h1 long, h2 long, n_docs long, last_doc long"
RESULT = "struct<kept_text: string, n_lines: long, n_dropped: long>"


def long_lines(text: bytes, min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Numbers and keys of the lines whose key has at least ``min_chars`` code points."""
    for i, line in enumerate(text.split(b"\n")):
        if len(line) >= min_chars:
            key = line.strip(STRIPPED)
            if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                yield i, key.lower()


def line_keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """Hash of each long enough key, and the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for i, key in long_lines(text, min_chars):
        found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(i)
    return found


def _lines(min_chars: int, n_batches: int):
    schema = pa.schema([("batch", pa.int32()), ("doc_id", pa.int64()), ("nameless", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() % n_batches
        for batch in pieces(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                nameless = hashlib.md5(text).hexdigest() if doc is None else None
                for h, places in line_keys(text, min_chars).items():
                    rows.append((number, doc, nameless, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), places))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


class LineRuns:
    """Levels of sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, fan: int = 3):
        self.spark, self.fan, self.root = spark, fan, scratch(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.root}/level-{level}/run-{self.made}"
        fewer(run).sortWithinPartitions("h1", "h2").write.parquet(path)
        self.made += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, lines: DataFrame) -> None:
        """A batch of (doc_id, h1, h2), one row for a key of a document."""
        self._write(lines.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")), 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            full = self._read(self.levels[level])
            self._write(self._merged(full), level + 1)
            for path in self.levels[level]:
                drop_folder(self.spark, path)
            self.levels[level] = []
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys of at least ``min_docs`` documents over all runs."""
        paths = [p for level in self.levels for p in level]
        return self._merged(self._read(paths)).where(F.col("n_docs") >= min_docs)


def _rewriter(min_chars: int):
    def rewrite(text: pd.Series, kept: pd.Series) -> pd.DataFrame:
        out = []
        for t, k in zip(text, kept, strict=True):
            stay = set(() if k is None else k)
            gone = {i for i, _ in long_lines(t.encode(), min_chars) if i not in stay}
            n = t.count("\n") + 1
            if gone:
                t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in gone])
            out.append((t, n, len(gone)))
        return pd.DataFrame(out, columns=["kept_text", "n_lines", "n_dropped"])

    return F.pandas_udf(rewrite, RESULT)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4, fan: int = 3) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all
    their lines but those in the largest ``doc_id`` that holds the key.  The documents go into the
    runs in ``n_batches`` batches of input partitions.
    """
    spark = docs.sparkSession
    lines = spark.read.schema(LINES).parquet(_written_batches(documents(docs).mapInArrow(_lines(min_chars, n_batches), LINES)))
    runs = LineRuns(spark, fan)
    for b in range(n_batches):
        runs.add(lines.where(F.col("batch") == b).select("doc_id", "h1", "h2"))
    frequent = written(fewer(runs.frequent(min_docs)), "frequent-lines").toDF("f1", "f2", "n_docs", "last_doc")
    same = (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & ((F.col("doc_id") < F.col("last_doc")) | (F.col("doc_id").isNull() & F.col("last_doc").isNotNull()))
    stay = lines.join(frequent.hint("merge"), same, "left_anti").groupBy(F.col("doc_id").alias("id"), F.col("nameless").alias("of")).agg(F.flatten(F.collect_list("places")).alias("kept"))
    own = {"kept_text", "n_lines", "n_dropped"}
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    whole = whole.withColumn("nameless", F.when(F.col("doc_id").isNull(), F.md5(text.cast("binary"))))
    done = whole.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("nameless").eqNullSafe(F.col("of")), "left").withColumn("new", _rewriter(min_chars)(text, "kept"))
    return done.select(*[F.col(f"row.{quoted(c)}") for c in docs.columns if c.lower() not in own], "new.kept_text", "new.n_lines", "new.n_dropped")


def _written_batches(lines: DataFrame) -> str:
    path = scratch(lines.sparkSession, "lines")
    lines.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    return path
