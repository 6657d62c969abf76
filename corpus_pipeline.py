"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
contaminated documents go, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.  All but the last return the
columns of documents; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayloom.llm import decontaminate, lines, near, packing, toxicity
from relayloom.llm.common import written
from relayloom.llm.queries import table, tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half; null and empty texts stay.  Repeated rows get one score, null ids are no reason to go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that op3 keeps; a null text stays null, and a row with a null id is a document of its own.

    Columns go through under other names, so that none is taken for one of the operator's.
    """
    names = docs.columns
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"user_{i}" for i, c in enumerate(names)])
    done = lines.dedup_lines(inner, min_chars=40, min_docs=5)
    done = done.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    if "n_chars" in names:
        done = done.withColumn(f"user_{names.index('n_chars')}", F.length("text").cast("long"))
    return done.select(*inner.columns).toDF(*names)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows with a null id, null texts and repeated rows of a kept one stay."""
    return near.drop_near_duplicates(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts have none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its end id alone, repeated rows are packed as often as they stand."""
    return packing.pack(docs, tokenizer_path(), end_id=1, size=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Scoring, sketches and tokenizing can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
