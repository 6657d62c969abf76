"""Message records: decoding, encoding, dead letters, Kafka and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "sender string, receiver string, content string, timestamp string, priority string, metadata string"
PRIORITIES = ["low", "normal", "high", "emergency"]


def decode(records: DataFrame) -> DataFrame:
    """Messages of (partition, offset, value): id ``partition-offset``, defaults for what is missing.

    ``ok`` is false for a value that is no JSON object; its other fields have their defaults.  Metadata
    is JSON in a string; what can't be read is null.
    """
    value = F.col("value").cast("string")
    e = F.from_json(value, ENVELOPE, {"mode": "PERMISSIVE"})
    text = lambda c, default: F.coalesce(F.col(f"e.{c}"), F.lit(default)).alias(c)
    priority = F.when(F.lower(F.col("e.priority")).isin(PRIORITIES), F.lower(F.col("e.priority"))).otherwise("normal")
    return records.withColumn("e", e).select(
        F.concat_ws("-", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("id"),
        text("sender", "unknown"), text("receiver", "system"), text("content", ""), F.try_to_timestamp("e.timestamp").alias("timestamp"), priority.alias("priority"),
        F.from_json("e.metadata", "map<string,string>").alias("metadata"), _readable(value).alias("ok"), value.alias("raw"),
    )


def _readable(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\s*\{") & (F.try_parse_json(value).isNotNull() if hasattr(F, "try_parse_json") else F.lit(True)), F.lit(False))


def encode(messages: DataFrame) -> DataFrame:
    """(key, value) to publish: the envelope as JSON, metadata as JSON within it."""
    meta = F.to_json(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    fields = F.struct("sender", "receiver", "content", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "priority", meta.alias("metadata"))
    return messages.select(F.col("sender").alias("key"), F.to_json(fields).alias("value"))


def dead_letters(decoded: DataFrame, failed_at: Column) -> tuple[DataFrame, DataFrame]:
    """(good, dead): messages, and the values that could not be read with a failure time."""
    return decoded.where("ok").drop("ok", "raw"), decoded.where("not ok").select("id", "raw", failed_at.alias("failed_at"))


def read_kafka(spark: SparkSession, servers: str, topic: str = "sms.inbound", **options: str) -> DataFrame:
    """A topic from its beginning (needs Spark's Kafka connector); pass it to ``decode``."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").options(**options).load()


def write_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    return encode(messages).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
