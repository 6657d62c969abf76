"""Traffic, model, latency and capacity roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def router_counters(outcomes: DataFrame) -> DataFrame:
    """One row from (message_type, route, responded, failed): counts by type and route, and the share answered without the model."""
    kind = {f"{t}_messages": F.count_if(F.col("message_type") == t) for t in ("emergency", "command", "template", "query")}
    route = {"routed_rag": F.count_if(F.col("message_type") == "query"), "routed_model": F.count_if(F.col("route") == "model"), "direct": F.count_if(F.col("route") == "direct")}
    done = {"responded": F.count_if("responded"), "failed": F.count_if("failed")}
    share = F.round(F.try_divide(F.count_if(F.col("route") == "direct"), F.count_if(F.col("message_type") == "query")), 4)
    return outcomes.agg(F.count("*").alias("received"), *[c.alias(n) for n, c in (kind | route | done).items()], share.alias("direct_share"))


def model_stats(calls: DataFrame) -> DataFrame:
    """One row from (ok, latency_s, tokens): totals, latency over successes and its band."""
    mean = F.avg(F.when(F.col("ok"), F.col("latency_s")))
    return calls.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.round(mean, 4).alias("mean_latency_s"), F.round(F.sum(F.when(F.col("ok"), F.col("latency_s"))), 4).alias("total_latency_s"),
        F.sum(F.when(F.col("ok"), F.col("tokens"))).alias("tokens"), F.when(mean < 5, "good").when(mean < 15, "warn").otherwise("bad").alias("band"),
    )


def service_counters(outcomes: DataFrame) -> DataFrame:
    """(service, total, ok, failed, last_ts) of an outcome log."""
    return outcomes.groupBy("service").agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.max("ts").alias("last_ts"))


def latency_percentiles(samples: DataFrame, by: str, value: str = "total_ms", approximate: bool = False) -> DataFrame:
    """p50, p95 and p99 with linear interpolation, completed, failed, throughput; approximate for huge groups."""
    good = F.when(F.col("ok"), F.col(value))
    p = F.percentile_approx(good, [0.5, 0.95, 0.99], 10_000) if approximate else F.percentile(good, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    df = samples.groupBy(by).agg(p.alias("p"), F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"), F.max(good).alias("_most"))
    return df.select(by, *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))], "completed", "failed", F.round(F.try_divide(F.col("completed") * 1000.0, F.col("_most")), 4).alias("throughput_per_s"))


#: Of quantile sketches (rank error about 0.4 %) and of distinct counts (standard error about 1.6 %).
QUANTILE_K, DISTINCT_LOG_K = 800, 12


def sketched(events: DataFrame, by: list[str], value: str, key: str, ts: str = "ts", length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, by..., n, quantiles, keys): for each window and group its count, a quantile sketch of ``value`` and a distinct sketch of ``key``.

    Sketches have a fixed size whatever the group's, combine map-side, and are kept to be rolled up later; the same on a
    stream, where a window is final when the watermark is ``delay`` past it.
    """
    df = events.withWatermark(ts, delay) if events.isStreaming else events
    grouped = df.groupBy(F.window(ts, length).alias("w"), *by)
    made = grouped.agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_K).alias("quantiles"), F.hll_sketch_agg(F.col(key).cast("string"), DISTINCT_LOG_K).alias("keys"))
    return made.select(F.col("w.start").alias("start"), *by, "n", "quantiles", "keys")


def rolled_up(sketches: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(by..., n, p50, p95, p99, keys) of ``sketched`` rows over any windows and groups: percentiles and distinct keys, to the sketches' errors."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("quantiles").alias("q"), F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("keys"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("q", F.lit(p)).alias(f"p{round(100 * p)}") for p in shares], "keys")


def bottleneck(samples: DataFrame, stages: list[str], by: str) -> DataFrame:
    """(by, stage, mean_ms): the stage with the largest mean, ties to the first listed."""
    long = samples.unpivot([by], stages, "stage", "ms")
    order = F.array(*map(F.lit, stages))
    mean = long.groupBy(by, "stage").agg(F.avg("ms").alias("mean_ms"))
    best = mean.groupBy(by).agg(F.max_by("stage", F.struct("mean_ms", -F.array_position(order, F.col("stage")))).alias("stage"), F.max("mean_ms").alias("mean_ms"))
    return best.select(by, "stage", F.round("mean_ms", 4).alias("mean_ms"))


def degradation(curve: DataFrame, by: str = "burst_size", value: str = "p95_ms", least: float = 0.8) -> DataFrame:
    """Adds previous and ok: the value must not fall below ``least`` times the one before (a row a burst size)."""
    before = F.lag(value).over(Window.orderBy(by))
    return curve.withColumn("previous", before).withColumn("ok", F.coalesce(F.col(value) >= least * before, F.lit(True)))


def message_history(*logs: DataFrame) -> DataFrame:
    """All drivers' logs, newest first."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out.orderBy(F.desc("ts"))
