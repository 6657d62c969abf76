"""Nodes and heartbeats: current state, summary, least-loaded routing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fleet_state(registrations: DataFrame, heartbeats: DataFrame, now: Column, silence: int = 60) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejected): each registered node with its latest metrics and status, and heartbeats of unknown nodes.

    A node was last seen at its latest registration or heartbeat; it is online if that is under
    ``silence`` seconds before ``now``.
    """
    reg = registrations.groupBy("node_id").agg(F.max("ts").alias("registered"), F.min("ts").alias("first_registered"), F.max_by("api_url", "ts").alias("api_url"))
    metrics = [c for c in heartbeats.columns if c not in ("node_id", "ts")]
    beat = heartbeats.groupBy("node_id").agg(F.max("ts").alias("beat"), F.max_by(F.struct(*metrics), "ts").alias("m"))
    df = reg.join(beat, "node_id", "left").withColumn("last_seen", F.greatest("registered", "beat"))
    online = (F.unix_micros(now) - F.unix_micros("last_seen")) < silence * 1_000_000
    nodes = df.select("node_id", "api_url", "first_registered", "last_seen", F.when(online, "online").otherwise("offline").alias("status"), *[F.col(f"m.{c}").alias(c) for c in metrics])
    return nodes, heartbeats.join(reg.select("node_id"), "node_id", "left_anti")


def fleet_summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("status") == "online").alias("online"), F.coalesce(F.sum("messages_received"), F.lit(0)).alias("messages"),
        F.round(F.avg("avg_latency_ms"), 4).alias("mean_latency_ms"), F.coalesce(F.sum("rag_direct"), F.lit(0)).alias("direct"),
    )


_ROUTED = "id {}, node_id string, load double"
_DEALT = "part int, at long, kind int, id {}, until long, load double, since long, node_id string"


def route_to_nodes(messages: DataFrame, heartbeats: DataFrame, nodes: DataFrame, silence: int = 60) -> DataFrame:
    """(id, node_id, load): as of each message's time, the online node of least load, ties to the first registered.

    Heartbeats become validity intervals, until the node's next one or until it has been silent too long.  Quantiles of
    all times, one a task, cut time to parts; a message goes to the part of its time (if many share an instant that
    is several cuts at once, to any part between those), an interval to each part that it reaches.  In a part both are
    swept in order of time over a heap of the nodes that are online, so a message meets one node and a busy
    minute is the work of many tasks.  A message without a time has no node.
    """
    spark = messages.sparkSession
    nxt = F.lead("at").over(Window.partitionBy("node_id").orderBy("at"))
    beat = heartbeats.select("node_id", F.unix_micros("ts").alias("at"), F.col("load").cast("double").alias("load")).where("at is not null")
    beat = beat.withColumn("until", F.least(F.coalesce(nxt, F.lit(1 << 62)), F.col("at") + silence * 1_000_000)).where("at < until")
    beat = beat.join(nodes.select("node_id", F.col("registered_at").cast("long").alias("since")), "node_id").withColumn("kind", F.lit(0))
    kind = dict(messages.dtypes)["id"]
    asked = messages.select("id", F.unix_micros("ts").alias("at"), F.lit(1).alias("kind"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.lit([(i + 1) / n for i in range(n - 1)] or [0.5])
    cuts = np.array(asked.agg(F.percentile_approx("at", shares)).first()[0] or [], dtype=np.int64)  # a number a task
    columns = ["part", "at", "kind", "id", "until", "load", "since", "node_id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, until = (pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in ("at", "until"))
            is_beat = batch.column("kind").to_numpy() == 0
            first = np.searchsorted(cuts, at, "left")
            last = np.searchsorted(cuts, np.where(is_beat, until - 1, at), "right")
            times = np.where(is_beat, last - first + 1, 1)
            row = np.repeat(np.arange(len(at)), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            part = first[row] + np.where(is_beat[row], step, row % (last - first + 1)[row])
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[out.column(c) for c in columns[1:]]], columns)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        online: list[tuple] = []
        most = 1024
        for batch in batches:
            got: list[tuple] = []
            keep = pc.equal(batch.column("kind"), 1)
            for at, is_message, until, *entry in zip(*[batch.column(c).to_pylist() for c in ("at", "kind", "until", "load", "since", "node_id")], strict=True):
                if not is_message:
                    heapq.heappush(online, (*_rank(*entry), until))
                    if len(online) > most:  # what is over below the top goes as well
                        online = [x for x in online if x[-1] > at]
                        heapq.heapify(online)
                        most = max(1024, 2 * len(online))
                    continue
                while online and at is not None and online[0][-1] <= at:
                    heapq.heappop(online)
                got.append((online[0][5], online[0][1]) if online and at is not None else (None, None))
            ids = batch.column("id").filter(keep)
            yield pa.RecordBatch.from_arrays([ids, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "node_id", "load"])

    both = beat.unionByName(asked, allowMissingColumns=True).select("at", "kind", "id", "until", "load", "since", "node_id")
    dealt = both.mapInArrow(deal, _DEALT.format(kind)).repartitionById(n, "part").sortWithinPartitions("at", "kind")
    return dealt.mapInArrow(sweep, _ROUTED.format(kind))


def _rank(load: float | None, since: int | None, node_id: str) -> tuple:
    """What orders nodes: Spark's order of (load, since, node_id), null before any number."""
    return (load is not None, load, since is not None, since, "", node_id)
