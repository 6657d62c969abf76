"""Sliding rate counts and admission by sender."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayloom.operators.buckets import MICRO, before, carried, with_halo
from relayloom.operators.folds import begin_states
from relayloom.operators.shared import kept


def rate_counts(messages: DataFrame, windows: dict[str, int], key: str = "sender", ts: str = "ts", edge: bool = False) -> DataFrame:
    """Adds, for each name and seconds, how many other messages of the key are younger than that.

    ``edge`` counts a message of exactly that age too (the gateway's rule); all rows of the same
    microsecond count each other.  Keys are cut to buckets of four times the longest window, each with a halo of one
    window, so at most a quarter of the rows is sent twice and a busy key takes many tasks.
    """
    longest = max(windows.values())
    df = with_halo(messages.withColumn("_us", F.unix_micros(ts)), "_us", 4 * longest, longest)
    for name, seconds in windows.items():
        frame = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-seconds * MICRO + (0 if edge else 1), 0)
        df = df.withColumn(name, F.count("*").over(frame) - 1)
    return df.where("_own").drop("_us", "_bucket", "_own")


class Limiter:
    """Admits a time if fewer than the limit were recorded in each window before it."""

    def __init__(self, limits: list[tuple[int, int]], edge: bool = False):
        self.limits, self.edge, self.kept = limits, edge, [deque() for _ in limits]

    def _old(self, then: int, now: int, seconds: int) -> bool:
        return now - then - (1 if self.edge else 0) >= seconds * MICRO

    def step(self, now: int, recordable: bool) -> tuple[bool, bool]:
        for held, (seconds, _) in zip(self.kept, self.limits, strict=True):
            while held and self._old(held[0], now, seconds):
                held.popleft()
        within = all(len(held) < most for held, (_, most) in zip(self.kept, self.limits, strict=True))
        if within and recordable:
            for held in self.kept:
                held.append(now)
        return within, within and recordable

    def state(self, at: int) -> list[int]:
        """The recorded times that the longest window still counts at ``at``."""
        seconds, held = max(((s, held) for (s, _), held in zip(self.limits, self.kept, strict=True)), key=lambda x: x[0])
        return [t for t in held if not self._old(t, at, seconds)]

    def start(self, state: list[int]) -> None:
        self.kept = [deque(state) for _ in self.limits]


def admission(messages: DataFrame, limits: list[tuple[int, int]], key: str = "sender", recordable: str | None = None, edge: bool = False, piece_windows: int = 16, piece_rows: int = 50_000) -> DataFrame:
    """Adds within_limits and recorded.  Wants id and ts; ties of a key go by id; a message without a time is admitted.

    A message after a pause longer than all windows starts a new run.  The raw count bounds the admitted count
    from above, so runs that never reach a limit by it are admitted by the window alone; only the others are
    folded, in order, with no more in memory than the times that still count.  Windows are counted in time buckets with
    halos, and a run of more than ``piece_rows`` messages is folded in pieces of ``piece_windows`` windows, side by
    side, so a busy key takes many tasks.  What a message is, is worked out once: the rows are written before they part.
    """
    longest = max(s for s, _ in limits)
    df = messages.withColumns({"_ok": F.coalesce(F.col(recordable), F.lit(False)) if recordable else F.lit(True), "_us": F.unix_micros("ts")})
    df = _runs(df, limits, key, longest + 1, edge)
    df = kept(df, "admission")
    df = df.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))  # a null key is one of its own
    busy_runs = df.where("_over").select("_key", "_start").distinct().withColumn("_busy", F.lit(True))
    df = df.join(busy_runs, ["_key", "_start"], "left")
    own = ["_ok", "_us", "_start", "_over", "_busy", "_key"]
    calm = df.where("_busy is null").withColumns({"within_limits": F.lit(True), "recorded": F.col("_ok")}).drop(*own)
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in messages.columns])
    busy = df.where("_busy").select(F.col("_key").alias("key"), F.col("_start").alias("run"), F.col("_us").alias("us"), F.col("id").alias("tie"), F.col("_ok").alias("ok"), row.alias("row"))
    return calm.unionByName(_folded(busy, limits, edge, max(2, piece_windows) * longest * MICRO, (longest + 1) * MICRO, piece_rows).select("row.*", "within_limits", "recorded"))


def _runs(df: DataFrame, limits: list[tuple[int, int]], key: str, pause: int, edge: bool) -> DataFrame:
    """Adds _start, the time that begins a row's run, and _over, whether its window reaches a limit."""
    df = with_halo(df, "_us", 4 * pause, pause)
    ordered = Window.partitionBy(key, "_bucket").orderBy("_us", "id")
    new = F.coalesce(F.col("_us") - F.lag("_us").over(ordered) > pause * MICRO, F.lit(True))
    over = F.lit(False)
    for seconds, most in limits:
        frame = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-seconds * MICRO + (0 if edge else 1), 0)
        over = over | (F.count("*").over(frame) > most)
    df = df.withColumns({"_new": new, "_over": over & F.col("_us").isNotNull()}).where("_own").drop("_own")
    here = F.last(F.when(F.col("_new"), F.col("_us")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    each = df.groupBy(key, "_bucket").agg(F.max(F.when(F.col("_new"), F.col("_us"))).alias("start"))
    earlier = F.last("start", ignorenulls=True).over(before(key))
    return carried(df.withColumn("_here", here), each, key, {"_earlier": earlier}).withColumn("_start", F.coalesce("_here", "_earlier")).drop("_bucket", "_new", "_here", "_earlier")


def _folded(busy: DataFrame, limits: list[tuple[int, int]], edge: bool, length: int, halo: int, piece_rows: int) -> DataFrame:
    """Runs through the limiter, whole rows in tow; large runs in pieces, each from the state that reaches it."""
    large = kept(busy.groupBy("key", "run").agg(F.count("*").alias("n")).where(F.col("n") > piece_rows).select("key", "run"), "large-runs")
    rows = busy.withColumns({"piece": F.lit(0).cast("long"), "kind": F.lit(1), "begin": F.lit(None).cast("array<long>")})
    if not large.isEmpty():
        cut = busy.join(large.withColumn("cut", F.lit(True)), ["key", "run"], "left")
        rows = cut.withColumns({"piece": F.when(F.col("cut"), F.floor((F.col("us") - F.col("run")) / F.lit(length))).otherwise(0).cast("long"), "kind": F.lit(1), "begin": F.lit(None).cast("array<long>")}).drop("cut")
        light = busy.select("key", "run", "us", "tie", "ok").join(large, ["key", "run"], "left_semi")
        states = begin_states(light, lambda: Limiter(limits, edge), length, halo)
        rows = rows.unionByName(states.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    dealt = rows.repartition("key", "run", "piece").sortWithinPartitions("key", "run", "piece", "kind", "us", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, limiter = None, Limiter(limits, edge)
        for batch in batches:
            got = []
            for key, number, piece, kind, us, ok, begin in zip(*[batch.column(c).to_pylist() for c in ("key", "run", "piece", "kind", "us", "ok", "begin")], strict=True):
                if group != (key, number, piece):
                    group, limiter = (key, number, piece), Limiter(limits, edge)
                if kind == 0:
                    limiter.start(begin)
                else:
                    got.append(limiter.step(us, ok))
            mine = pc.equal(batch.column("kind"), 1)
            flags = [pa.array([g[i] for g in got], pa.bool_()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(mine), *flags], names=["row", "within_limits", "recorded"])

    kind = dealt.schema["row"].dataType.simpleString()
    return dealt.mapInArrow(run, f"row {kind}, within_limits boolean, recorded boolean")
