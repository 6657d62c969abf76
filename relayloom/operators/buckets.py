"""Windows over a key's rows in time buckets, so that a busy key is the work of many tasks.

What a bucket needs from before it is either a halo, copies of the rows that its frames reach back to, or a carry: a
small summary of each bucket, run through in order by key, one row a bucket however many rows that has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def bucket(us: Column, seconds: int) -> Column:
    return F.floor(us / F.lit(seconds * MICRO)).cast("long")


def with_halo(df: DataFrame, us: str, seconds: int, halo: int) -> DataFrame:
    """Adds _bucket and _own: each row in its bucket of ``seconds``, and again, not _own, in later ones that start up to ``halo`` seconds after it.

    A row without a time is in the bucket null.
    """
    own, last = bucket(F.col(us), seconds), bucket(F.col(us) + halo * MICRO, seconds)
    return df.withColumn("_bucket", F.explode_outer(F.sequence(own, last))).withColumn("_own", F.col("_bucket").eqNullSafe(bucket(F.col(us), seconds)))


def in_bucket(key: str) -> Window:
    return Window.partitionBy(key, "_bucket").orderBy("ts", "id")


def carried(rows: DataFrame, summary: DataFrame, key: str, carry: dict[str, Column]) -> DataFrame:
    """``rows`` with what their bucket carries over from those before; ``carry`` is over ``summary``, a row a key and bucket."""
    kept = summary.withColumns(carry).select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), *carry)
    return rows.join(kept, F.col(key).eqNullSafe(F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b"))).drop("_k", "_b")


def before(key: str) -> Window:
    """The buckets of a key before each one."""
    return Window.partitionBy(key).orderBy(F.asc_nulls_first("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
