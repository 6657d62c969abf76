"""Streaming forms of the operators; times are the messages' own, with a watermark.

Stateful processors hold messages until the watermark passes them and then work them off in order
of (ts, id), so a stream gives the batch answer whatever order rows come in.  Rows later than the
watermark are dropped by Spark before they reach a processor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from relayloom.operators import privacy, text
from relayloom.operators.dialog import Hunt
from relayloom.operators.rate import MICRO
from relayloom.sources.messages import dead_letters, decode

DELAY = "10 minutes"


def understood(messages: DataFrame, content: str = "content") -> DataFrame:
    """Classified and screened messages; projections only, so the same on a stream or a table."""
    return privacy.pii_scan(text.route_class(messages, content), content)


def deduplicated(messages: DataFrame, ts: str = "timestamp", delay: str = DELAY) -> DataFrame:
    """One row an id; on a stream, redelivered ones are known until the watermark is ``delay`` past them."""
    if not messages.isStreaming:
        return messages.dropDuplicates(["id"])
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])


def start_router(records: DataFrame, good_path: str, dead_path: str, checkpoint: str, **trigger: object):
    """Decode, understand, screen and write; dead letters apart.  Offsets move on after both writes.

    A batch has its own ``batch_id`` folder in either table and replaces it, so one that is tried again is not
    written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode(batch).persist()
        good, dead = dead_letters(decoded, F.current_timestamp())
        understood(good).drop("detected").write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
        dead.write.mode("overwrite").parquet(f"{dead_path}/batch_id={batch_id}")
        decoded.unpersist()

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def start_router_table(records: DataFrame, path: str, checkpoint: str, **trigger: object):
    """Decode, understand, screen and write to one table by Spark's own file sink, dead letters in the partition readable=false.

    The sink's commit log makes each batch visible as a whole and once, over restarts.  It knows batches by number, so a
    query has a folder of its own, named by its checkpoint: another query on the same table adds to it.
    """
    decoded = understood(decode(records).withColumn("failed_at", F.when(~F.col("ok"), F.current_timestamp()))).drop("detected")
    table = decoded.withColumnRenamed("ok", "readable").withColumn("raw", F.when(~F.col("readable"), F.col("raw")))
    folder = f"{path}/query-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"
    writer = table.writeStream.format("parquet").partitionBy("readable").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start(folder)


def read_routed(spark: SparkSession, path: str) -> DataFrame:
    """What the queries of ``start_router_table`` have committed to a table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = sorted(f.getPath().toString() for f in files.listStatus(hadoop) if f.isDirectory() and f.getPath().getName().startswith("query-"))
    return reduce(DataFrame.unionByName, [spark.read.parquet(f) for f in folders]).withColumn("readable", F.col("readable").cast("boolean"))


def traffic(messages: DataFrame, ts: str = "ts", kind: str = "message_type", length: str = "1 minute", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Counts by window and type; with ``slide`` the windows overlap."""
    df = messages.withWatermark(ts, delay) if messages.isStreaming else messages
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def conversation_sessions(turns: DataFrame, gap: str = "3600 seconds", delay: str = DELAY) -> DataFrame:
    """(sender, start, end, turns): sessions end after a gap; one of exactly the gap still merges."""
    df = turns.withWatermark("ts", delay) if turns.isStreaming else turns
    return df.groupBy("sender", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("turns")).select("sender", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def _plain(value: object) -> object:
    """A state's value as lists and tuples, whether it comes from the store or from a pandas row."""
    if isinstance(value, dict):
        return tuple(value.values())
    if isinstance(value, tuple):
        return tuple(map(_plain, value))
    if isinstance(value, (list, np.ndarray)):
        return [_plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


class Ordered(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then folds them in order.

    Waiting rows are kept by the time of their timer, so a timer reads its own rows only.  A key that was idle
    for ``keep`` seconds, after which its state says nothing any more, loses its state (by a timer, as states that Spark
    itself lets expire go by the clock and not by the messages' times).  ``after`` makes the state of a table, so that a
    stream can go on where a batch ended (``initial`` of ``stateful``).
    """

    columns: list[str]
    keep: int
    #: Columns of a key's state with their types, and their values for a new key; ``us`` follows, the time of its last message.
    STATE: dict[str, str]
    START: tuple

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows array<struct<us: long, id: long, content: string, reply: string, recordable: boolean>>")
        self.value = handle.getValueState("value", ", ".join(f"{c} {t}" for c, t in {**self.STATE, "us": "long"}.items()))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for r in initialState.itertuples():
            state = tuple(_plain(getattr(r, c)) for c in self.STATE)
            self.value.update((*state, int(r.us)))
            self.handle.registerTimer(self._idle(int(r.us)) + 1)

    def _idle(self, us: int) -> int:
        """The last time, in milliseconds, at which a key whose last message was at ``us`` has a state."""
        return us // 1000 + self.keep * 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held: dict[int, list] = {}
        for pdf in rows:
            for r in pdf.itertuples():
                at = max(int(r.us) // 1000 + 1, now + 1)
                held.setdefault(at, []).append((int(r.us), int(r.id), str(getattr(r, "content", "") or ""), str(getattr(r, "reply", "") or ""), bool(getattr(r, "recordable", True))))
        for at, new in held.items():
            before = _plain(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
            self.waiting.updateValue((at,), (before + new,))
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.waiting.containsKey((at,)):
            *state, last = _plain(self.value.get()) if self.value.exists() else (*self.START, 0)
            for us, i, content, reply, recordable in sorted(_plain(self.waiting.getValue((at,))[0])):
                self.recordable = recordable
                made, state = self.fold(tuple(state), us, content, reply)
                last = max(last, us)
                if made is not None:
                    out.append((*key, i, *made))
            self.waiting.removeKey((at,))
            self.value.update((*state, last))
            self.handle.registerTimer(max(self._idle(last), at) + 1)
        elif self.value.exists() and at > self._idle(self.value.get()[-1]):
            self.value.clear()
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass

    def fold(self, state: tuple, us: int, content: str, reply: str) -> tuple[tuple | None, tuple]:
        """What a row gives, if anything, and the state after it."""
        raise NotImplementedError

    def after(self, table: DataFrame) -> DataFrame:
        """(sender, columns of the state, us) from the batch operator's rows: a stream's initial state."""
        raise NotImplementedError


class Admission(Ordered):
    """Rate admission by sender: state is the recorded times that may still count.

    A message whose ``recordable`` is false is held against the limits but uses up none of them, as in the batch
    operator; with ``recorded`` the rows say as well whether a message was recorded.
    """

    columns = ["sender", "id", "within_limits"]
    SCHEMA = "sender string, id long, within_limits boolean, recorded boolean"
    STATE, START = {"times": "array<long>"}, ([],)

    def __init__(self, limits: list[tuple[int, int]], recorded: bool = False):
        self.limits, self.keep, self.tells = limits, max(s for s, _ in limits), recorded
        if recorded:
            self.columns = [*self.columns, "recorded"]

    def fold(self, state: tuple, us: int, content: str, reply: str) -> tuple[tuple | None, tuple]:
        kept = [t for t in state[0] if us - t < self.keep * MICRO]
        within = all(sum(us - t < s * MICRO for t in kept) < most for s, most in self.limits)
        recorded = within and self.recordable
        return ((within, recorded) if self.tells else (within,)), ([*kept, us] if recorded else kept,)

    def after(self, table: DataFrame) -> DataFrame:
        """Of (sender, ts, recorded) rows as ``rate.admission`` makes them; no sender has more times than a limit allows."""
        rows = table.select("sender", F.unix_micros("ts").alias("at"), "recorded").where("at is not null")
        last = rows.groupBy("sender").agg(F.max("at").alias("us"))
        recent = rows.where("recorded").join(last, "sender").where(F.col("us") - F.col("at") < self.keep * MICRO)
        times = recent.groupBy("sender").agg(F.array_sort(F.collect_list("at")).alias("times"))
        return last.join(times, "sender", "left").select("sender", F.coalesce("times", F.array().cast("array<bigint>")).alias("times"), "us")


def admitted(messages: DataFrame, limits: list[tuple[int, int]], delay: str = DELAY, decided: DataFrame | None = None) -> DataFrame:
    """A stream of Admission rows of (sender, id, ts, content): texts are screened first, and high-risk ones aren't recorded.

    It goes on from ``decided``, rows of the batch operator on earlier messages, if there are any.
    """
    screened = privacy.pii_scan(messages).withColumn("recordable", F.col("risk_level") != "high").select("sender", "id", "ts", "recordable")
    processor = Admission(limits, recorded=True)
    return stateful(screened, processor, Admission.SCHEMA, delay=delay, initial=None if decided is None else processor.after(decided))


class Hunting(Ordered):
    """The treasure hunt by sender: state is clue number and last touched time."""

    columns = ["sender", "id", "reply", "state", "next_state"]
    STATE, START = {"number": "int", "touched": "long"}, (0, 0)

    def __init__(self, intro: str, clues: list[dict], ttl: int = 86_400):
        self.hunt, self.keep = Hunt(intro, clues), ttl

    def fold(self, state: tuple, us: int, content: str, reply: str) -> tuple[tuple | None, tuple]:
        number, touched = state
        if touched and us - touched > self.keep * MICRO:
            number = 0
        said, after = self.hunt.step(number, content)
        return None if said is None else (said, number, after), (after, us if said is not None else touched)

    def after(self, table: DataFrame) -> DataFrame:
        """Of rows as ``dialog.hunt_replies`` makes them."""
        at = F.unix_micros("ts")
        newest = F.max_by(F.struct(F.col("next_state").cast("int").alias("number"), at.alias("touched")), F.struct(at, F.col("id")))
        return table.groupBy("sender").agg(newest.alias("x")).select("sender", "x.*", F.col("x.touched").alias("us"))


class History(Ordered):
    """Chat history by sender: the newest turns that each message sees; idle senders start anew, ``/reset`` forgets.

    Messages have content and reply; ``history`` holds {user, assistant} of the turns before.
    """

    columns = ["sender", "id", "history"]
    SCHEMA = "sender string, id long, history array<struct<user: string, assistant: string>>"
    STATE, START = {"turns": "array<struct<user: string, assistant: string>>", "touched": "long"}, ([], 0)

    def __init__(self, turns: int = 10, ttl: int = 3600):
        self.turns, self.keep = turns, ttl

    def fold(self, state: tuple, us: int, content: str, reply: str) -> tuple[tuple | None, tuple]:
        turns, touched = state
        if touched and us - touched > self.keep * MICRO:
            turns = []
        if content.strip().lower() == "/reset":
            return ([],), ([], us)
        seen = [{"user": u, "assistant": a} for u, a in turns]
        return (seen,), ([*turns, (content, reply)][-self.turns :], us)

    def after(self, table: DataFrame) -> DataFrame:
        """Of rows as ``dialog.visible_history`` makes them of as many turns: what the next message would see."""
        at = F.unix_micros("ts")
        own = F.array(F.struct(F.coalesce("content", F.lit("")).alias("user"), F.coalesce("reply", F.lit("")).alias("assistant")))
        seen = F.concat("history", own)
        turns = F.when(F.coalesce("reset", F.lit(False)), F.slice(own, 1, 0)).otherwise(F.slice(seen, F.greatest(F.size(seen) - self.turns + 1, F.lit(1)), self.turns))
        newest = F.max_by(F.struct(turns.alias("turns"), at.alias("touched")), F.struct(at, F.col("id")))
        return table.groupBy("sender").agg(newest.alias("x")).select("sender", "x.*", F.col("x.touched").alias("us"))


class NodeStatus(StatefulProcessor):
    """A node's newest heartbeat with its metrics, online; and offline when none came for ``silence`` seconds of event time."""

    METRICS = ("messages_received", "avg_latency_ms", "rag_direct")
    SCHEMA = "node_id string, us long, status string, messages_received long, avg_latency_ms double, rag_direct long"

    def __init__(self, silence: int = 60):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, messages_received long, avg_latency_ms double, rag_direct long")

    def _row(self, key, us: int, status: str, metrics: tuple) -> pd.DataFrame:
        return pd.DataFrame([(*key, us, status, *metrics)], columns=["node_id", "us", "status", *self.METRICS]).astype({m: t for m, t in zip(self.METRICS, ("Int64", "Float64", "Int64"), strict=True)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        metrics = lambda r: tuple(None if pd.isna(v := getattr(r, m)) else kind(v) for m, kind in zip(self.METRICS, (int, float, int), strict=True))
        newest = max(((int(r.us), metrics(r)) for pdf in rows for r in pdf.itertuples()), key=lambda x: x[0])
        if not self.last.exists() or newest[0] > self.last.get()[0]:
            self.last.update((newest[0], *newest[1]))
            self.handle.registerTimer(newest[0] // 1000 + self.silence * 1000)
            yield self._row(key, newest[0], "online", newest[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, *metrics = self.last.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= us // 1000 + self.silence * 1000:
            yield self._row(key, us, "offline", tuple(metrics))

    def close(self) -> None:
        pass


def node_changes(heartbeats: DataFrame, registrations: DataFrame, silence: int = 60, delay: str = DELAY) -> DataFrame:
    """A stream of NodeStatus rows of (node_id, ts, metrics) heartbeats; those of unregistered nodes are left out."""
    known = registrations.select("node_id").distinct()
    return stateful(heartbeats.join(known, "node_id", "left_semi"), NodeStatus(silence), NodeStatus.SCHEMA, "node_id", delay)


def node_table(changes: DataFrame) -> DataFrame:
    """The newest row of each node, one of equal time being offline last."""
    newest = F.max_by(F.struct(*[c for c in changes.columns if c != "node_id"]), F.struct("us", (F.col("status") == "offline").alias("off")))
    return changes.groupBy("node_id").agg(newest.alias("x")).select("node_id", "x.*")


def stateful(messages: DataFrame, processor: StatefulProcessor, schema: str | StructType, key: str = "sender", delay: str = DELAY, initial: DataFrame | None = None) -> DataFrame:
    """A stream of (key, id, ts, content) through a processor; needs the RocksDB state store provider.

    ``initial`` is the state of a table that the stream continues, a row a key (``after`` of the processor).
    """
    df = messages.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    begun = initial.groupBy(key) if initial is not None else None
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", initialState=begun)
