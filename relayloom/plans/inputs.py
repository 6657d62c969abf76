"""The driver's tables in the shapes that the operators read, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of any script, for DuckDB's regex engine.
WS = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\p{Z}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.substring("text", 1, 30).alias("title"), "text", F.col("source").alias("category"), "lang", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, substring(t, 1, 30) AS title, t AS text, source AS category, lang FROM (SELECT *, coalesce(text, '') AS t FROM documents))"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ts = F.timestamp_micros((F.lit(1_704_067_200) + F.col("turn") * 1200 + F.when(F.col("turn") > 3, 4000).otherwise(0)) * 1_000_000)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("sender"), ts.alias("ts"), "role", F.coalesce("text", F.lit("")).alias("content"))


TURNS = "(SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS sender, (1704067200 + turn * 1200 + CASE WHEN turn > 3 THEN 4000 ELSE 0 END) * 1000000 AS us, role, coalesce(text, '') AS content FROM conversations)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("sender"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


EVENTS = "(SELECT event_id AS id, CAST(user_id AS VARCHAR) AS sender, ts, epoch_us(ts) AS us, event_type, value FROM events)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: the content is the text of the document of the same number, if there is one."""
    said = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return events(spark, sf_dir).join(said, "id", "left").withColumn("content", F.coalesce("content", F.lit("")))


MESSAGES = f"(SELECT e.*, coalesce(d.text, '') AS content FROM {EVENTS} e LEFT JOIN documents d ON d.doc_id = e.id)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a raw stream: JSON envelopes, every seventh of them broken off, a tenth of them delivered twice."""
    c = table(spark, sf_dir, "conversations")
    meta = F.to_json(F.struct(F.col("role").alias("role")))
    body = F.to_json(F.struct(F.col("conv_id").cast("string").alias("sender"), F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, "HIGH").when(F.col("turn") % 3 == 1, "odd").alias("priority"), meta.alias("metadata")))
    value = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "{broken").otherwise(body)
    one = c.select(F.col("conv_id").cast("int").alias("partition"), F.col("turn").alias("offset"), value.alias("value"))
    return one.unionByName(one.where("(partition + offset) % 10 = 3"))


RECORDS = """(SELECT *, (conv_id + turn) % 7 <> 0 AS ok FROM (SELECT * FROM conversations UNION ALL SELECT * FROM conversations WHERE (conv_id + turn) % 10 = 3))"""


def ascii_letters(text: Column) -> Column:
    """Letters and digits beyond ASCII as x, so that a digest can be compared with an engine whose word class is ASCII."""
    return F.regexp_replace(text, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "x")


def ascii_letters_sql(column: str) -> str:
    """The same in SQL."""
    return rf"regexp_replace(regexp_replace({column}, '[^\x00-\x7F\P{{L}}]', 'x', 'g'), '[^\x00-\x7F\P{{N}}]', 'x', 'g')"
