"""Document tables in buckets of ids, so that a change reads, shuffles and writes the buckets it touches and no others.

A table is a folder with ``rows`` (partitioned by bucket), ``meta`` (how many buckets) and ``log``, the changes of each
version.  Rows need an id and a content_hash.  One job at a time may change a table; what it replaces is swapped bucket by
bucket when its rows are written, and its log entry comes last, so a version is complete once the log has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relayloom.operators.corpus import delete, index_changes, upsert

LOG = "version long, id string, change string"


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int) -> None:
    dealt = rows.withColumn("bucket", bucket_of(F.col("id"), buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", "id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")


def create_table(rows: DataFrame, path: str, buckets: int = 64) -> None:
    spark = rows.sparkSession
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/meta")
    _write(rows, path, buckets)
    spark.createDataFrame([], LOG).coalesce(1).write.parquet(f"{path}/log")


def read_table(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a table, or of some buckets, whose files alone are read then."""
    rows = spark.read.parquet(f"{path}/rows")
    return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(version, id, change): what each change of the table added, changed and removed."""
    return spark.read.schema(LOG).parquet(f"{path}/log")


def _changed(ids: DataFrame, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Replaces the buckets of ``ids`` by what ``change`` makes of their rows; the new version."""
    spark = ids.sparkSession
    n = spark.read.parquet(f"{path}/meta").first().buckets
    touched = [r.bucket for r in ids.select(bucket_of(F.col("id"), n).alias("bucket")).distinct().collect()]  # numbers of buckets
    version = (read_log(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    before = read_table(spark, path, touched)
    after = change(before)
    told = index_changes(before.select("id", "content_hash"), after.select("id", "content_hash")).select(F.lit(version).cast("long").alias("version"), F.col("id").cast("string").alias("id"), "change")
    told.write.parquet(f"{path}/log-{version}")
    filled = {r.bucket for r in after.select(bucket_of(F.col("id"), n).alias("bucket")).distinct().collect()}
    _write(after, path, n)
    for b in set(touched) - filled:
        _drop(spark, f"{path}/rows/bucket={b}")
    spark.read.schema(LOG).parquet(f"{path}/log-{version}").write.mode("append").parquet(f"{path}/log")
    _drop(spark, f"{path}/log-{version}")
    return version


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merge_into(patch: DataFrame, path: str, order: str = "seq", keep_created: bool = True) -> int:
    """Upserts the last patch row of each id, as ``upsert`` does; the table's new version."""
    return _changed(patch, path, lambda rows: upsert(rows, patch, order, keep_created))


def delete_from(ids: DataFrame, path: str) -> int:
    """Deletes rows by id; the table's new version."""
    return _changed(ids, path, lambda rows: delete(rows, ids))
