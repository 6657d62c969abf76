"""Answers against ground truth: scores, reports, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayloom.functions import vocabulary as V


def with_truth(responses: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined, unknown): responses with the columns of their query, and those whose query_id is not known."""
    t = truth.withColumnRenamed("id", "query_id")
    return responses.join(t, "query_id"), responses.join(t.select("query_id"), "query_id", "left_anti")


def _repeated(words: Column, n: int) -> Column:
    """Share of repeats among the runs of n words: a run seen c > 2 times adds c - 1.  Equal runs lie together once sorted."""
    runs = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n))))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("seen"), F.lit(0).alias("extra"))

    def step(acc: Column, run: Column) -> Column:
        seen = F.when(acc["last"] == run, acc["seen"] + 1).otherwise(1)
        return F.struct(run.alias("last"), seen.alias("seen"), (acc["extra"] + F.when(seen == 3, 2).when(seen > 3, 1).otherwise(0)).alias("extra"))

    return F.aggregate(runs, start, step, lambda acc: acc["extra"]) / (F.size(words) - (n - 1))


def with_repetition(responses: DataFrame, text: str = "response") -> DataFrame:
    """Adds repetition: 1 less the mean share of repeated bigrams and trigrams, 1 for fewer than four words.  No shuffle."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    df = responses.withColumn("_w", words)
    penalty = F.least(F.lit(1.0), (_repeated(F.col("_w"), 2) + _repeated(F.col("_w"), 3)) / 2)
    return df.withColumn("repetition", F.round(1 - F.when(F.size("_w") >= 4, penalty).otherwise(0.0), 4)).drop("_w")


def repetition(responses: DataFrame, key: str = "id", text: str = "response") -> DataFrame:
    """(key, repetition) of each row."""
    return with_repetition(responses, text).select(key, "repetition")


def score(joined: DataFrame, weights: dict[str, float] | None = None, key: str = "query_id") -> DataFrame:
    """Adds the scores of each dimension, hit and miss lists, composite and pass; wants ``repetition``."""
    w = dict(weights or V.WEIGHTS)
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()} if total > 0 else w
    low = F.lower(F.coalesce("response", F.lit("")))
    hits = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda k: F.contains(low, F.lower(k)))
    misses = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda k: ~F.contains(low, F.lower(k)))
    df = joined.withColumns({"keyword_hits": hits("expected_keywords"), "keyword_misses": misses("expected_keywords"), "entity_hits": hits("expected_entities"), "entity_misses": misses("expected_entities"), "forbidden_found": hits("forbidden_keywords")})
    recall = lambda a, b: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(F.size(a) / (F.size(a) + F.size(b)))
    most = F.coalesce("max_acceptable_latency_ms", F.lit(15000.0))
    late = F.when(F.col("latency_ms") <= most, 1.0).when(F.col("latency_ms") <= 2 * most, 1 - (F.col("latency_ms") - most) / most).otherwise(0.0)
    df = df.withColumns({
        "keyword_score": recall("keyword_hits", "keyword_misses"), "entity_score": recall("entity_hits", "entity_misses"), "forbidden_score": F.when(F.size("forbidden_found") == 0, 1.0).otherwise(0.0),
        "length_score": F.when(F.length(F.coalesce("response", F.lit(""))) <= V.SMS_LENGTH, 1.0).otherwise(0.0), "latency_score": late,
    })
    composite = sum((F.lit(v) * F.col("repetition" if k == "repetition" else f"{k}_score") for k, v in w.items()), F.lit(0.0))
    return df.withColumn("composite", composite).withColumn("pass", F.col("composite") >= V.PASS_AT).withColumn("composite_score", F.round("composite", 4))


def report(scored: DataFrame) -> DataFrame:
    """Totals, pass rate and mean scores for each category and, with a null category, of all."""
    return scored.rollup("category").agg(
        F.count("*").alias("total"), F.count_if("pass").alias("passed"), F.count_if(~F.col("pass")).alias("failed"), F.round(F.count_if("pass") / F.count("*"), 4).alias("pass_rate"),
        F.round(F.avg("composite"), 4).alias("mean_composite"), F.round(F.avg("keyword_score"), 4).alias("mean_keyword"), F.round(F.avg("latency_ms"), 4).alias("mean_latency_ms"),
    )


def gates(reported: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(category, metric, value, threshold, ok) of thresholds (category or null, metric, least) met by a report."""
    long = reported.unpivot(["category"], ["pass_rate", "mean_composite", "mean_keyword"], "metric", "value")
    t = thresholds.withColumnRenamed("category", "_category").withColumnRenamed("metric", "_metric")
    joined = long.join(t, F.col("category").eqNullSafe(F.col("_category")) & (F.col("metric") == F.col("_metric")))
    return joined.select("category", "metric", "value", F.col("least").alias("threshold"), (F.col("value") >= F.col("least")).alias("ok"))
