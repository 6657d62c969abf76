"""Conversation state by sender: sessions, history, the treasure hunt."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relayloom.functions import vocabulary as V
from relayloom.operators.buckets import MICRO, before, bucket, carried, in_bucket
from relayloom.operators.folds import fold_in_order
from relayloom.operators.text import strip


def sessions(turns: DataFrame, gap: int = 3600, key: str = "sender", bucket_seconds: int = 86_400) -> DataFrame:
    """Adds session, a number by sender that grows when the sender was idle for more than ``gap`` seconds.

    A sender's turns are numbered in time buckets; from bucket to bucket go the last time and the number so far.
    """
    w = in_bucket(key)
    idle = F.col("_us") - F.lag("_us").over(w) > gap * MICRO
    df = turns.withColumn("_us", F.unix_micros("ts")).withColumn("_bucket", bucket(F.col("_us"), bucket_seconds))
    df = df.withColumn("_new", F.coalesce(idle, F.lit(False)).cast("int")).withColumn("_nth", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = df.groupBy(key, "_bucket").agg(F.min("_us").alias("first"), F.max("_us").alias("last"), F.max("_nth").alias("new"))
    fresh = F.coalesce(F.col("first") - F.last("last", ignorenulls=True).over(before(key)) > gap * MICRO, F.lit(False)).cast("int")
    each = each.withColumn("fresh", fresh)
    earlier = F.coalesce(F.sum(F.col("new") + F.col("fresh")).over(before(key)), F.lit(0)) + F.col("fresh")
    return carried(df, each, key, {"_earlier": earlier}).withColumn("session", F.col("_earlier") + F.col("_nth")).drop("_us", "_bucket", "_new", "_nth", "_earlier")


def last_turns(turns: DataFrame, n: int = 10, key: str = "sender") -> DataFrame:
    """The newest ``n`` turns of each sender's session; Spark keeps n a session in each task before it shuffles."""
    w = Window.partitionBy(key, "session").orderBy(F.desc("ts"), F.desc("id"))
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def visible_history(turns: DataFrame, n: int = 10, key: str = "sender", bucket_seconds: int = 86_400) -> DataFrame:
    """Adds history: the up to ``n`` turns before each one in its session and since the last ``/reset``.

    Turns have id, ts, content, reply and reset (true for a turn that clears the history).  A sender's turns are cut
    to time buckets; from bucket to bucket go the number of resets so far and the newest ``n`` turns.
    """
    w = in_bucket(key)
    reset = F.coalesce(F.col("reset"), F.lit(False))
    turn = F.when(~reset, F.struct(F.col("content").alias("user"), F.col("reply").alias("assistant")))
    df = turns.withColumn("_bucket", bucket(F.unix_micros("ts"), bucket_seconds))
    df = df.withColumns({"_resets": F.sum(reset.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_turn": turn})
    newest = Window.partitionBy(key, "_bucket").orderBy(F.desc("ts"), F.desc("id"))
    tail = df.select(key, "_bucket", "session", "_resets", "_turn", F.row_number().over(newest).alias("_r")).where(F.col("_r") <= n)
    each = tail.groupBy(key, "_bucket").agg(F.max("_resets").alias("resets"), F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("at"), "session", "_resets", "_turn"))).alias("tail"))
    each = each.withColumn("earlier", F.coalesce(F.sum("resets").over(before(key)), F.lit(0)))
    each = each.withColumn("tail", F.transform("tail", lambda x: F.struct(x["session"].alias("session"), (x["_resets"] + F.col("earlier")).alias("part"), x["_turn"].alias("turn"))))
    carry = {"_earlier": F.col("earlier"), "_tail": F.flatten(F.collect_list("tail").over(before(key).rowsBetween(-n, -1)))}
    df = carried(df, each, key, carry).withColumn("_part", F.col("_earlier") + F.col("_resets"))
    mine = Window.partitionBy(key, "_bucket", "session", "_part").orderBy("ts", "id")
    df = df.withColumns({"_here": F.collect_list("_turn").over(mine.rowsBetween(-n, -1)), "_at": F.row_number().over(mine)})
    same = F.filter("_tail", lambda x: x["session"].eqNullSafe(F.col("session")) & (x["part"] == F.col("_part")))
    more = F.greatest(F.lit(n + 1) - F.col("_at"), F.lit(0))  # turns that the bucket itself doesn't have
    from_before = F.slice(same, F.greatest(F.size(same) - more + 1, F.lit(1)), more)
    history = F.concat(F.array_compact(F.transform(from_before, lambda x: x["turn"])), F.col("_here"))
    return df.withColumn("history", history).drop("_bucket", "_resets", "_turn", "_earlier", "_tail", "_part", "_here", "_at")


def history_blocks(turns: DataFrame, size: int = 256, key: str = "sender", bucket_seconds: int = 86_400) -> DataFrame:
    """(sender, block, first_ts, last_ts, n, turns): each sender's turns in order, ``size`` in a row as {role, content}.

    Turns are numbered in time buckets, with the number of turns in the buckets before carried over; so neither a row nor
    a task holds more of a busy sender than a block or a bucket.
    """
    df = turns.withColumn("_bucket", bucket(F.unix_micros("ts"), bucket_seconds)).withColumn("_nth", F.row_number().over(in_bucket(key)))
    each = df.groupBy(key, "_bucket").agg(F.count("*").alias("n"))
    df = carried(df, each, key, {"_earlier": F.coalesce(F.sum("n").over(before(key)), F.lit(0))}).withColumn("_at", F.col("_earlier") + F.col("_nth") - 1)
    block = F.floor(F.col("_at") / F.lit(size)).cast("long")
    said = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), "role", "content")))
    grouped = df.groupBy(key, block.alias("block")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), said.alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))


def newest_history(blocks: DataFrame, n: int = 10, size: int = 256, key: str = "sender") -> DataFrame:
    """(sender, history): the newest ``n`` turns of each sender, from its newest blocks (of ``size`` turns) alone.

    All blocks but a sender's last are full, so as many as hold ``n`` turns and one more are enough.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("block"))
    few = blocks.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= -(-n // size) + 1)
    joined = few.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "turns"))), lambda b: b["turns"])).alias("all"))
    return joined.select(key, F.slice("all", F.greatest(F.size("all") - n + 1, F.lit(1)), n).alias("history"))


def history_arrays(turns: DataFrame, key: str = "sender") -> DataFrame:
    """(sender, history): all turns in order as an array of {role, content}, its blocks joined; for senders whose history fits a row."""
    blocks = history_blocks(turns, key=key)
    return blocks.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "turns"))), lambda b: b["turns"])).alias("history"))


_CLUE = re.compile(r"clue\s*(\d+)")


class Hunt:
    """The rules of a treasure hunt: text and state to reply and next state.

    What a message gets depends on its kind (start, hint, clue or said) and on whether the hunt is on.
    """

    def __init__(self, intro: str, clues: list[dict]):
        self.clues = {c["id"]: c for c in clues}
        start = lambda state, asked, said: (intro, 1)
        self.rules: dict[tuple[str, bool], Callable[[int, int, str], tuple[str | None, int]]] = {
            ("start", False): start,
            ("start", True): start,
            ("hint", False): lambda state, asked, said: (V.HUNT["hint_early"], state),
            ("hint", True): lambda state, asked, said: (self._of(state, "hint", V.HUNT["no_hint"]), state),
            ("clue", False): lambda state, asked, said: (V.HUNT["clue_early"], state),
            ("clue", True): lambda state, asked, said: (self._of(asked, "clue", V.HUNT["no_clue"]) if asked <= state else V.HUNT["locked"].format(asked=asked, state=state), state),
            ("said", False): lambda state, asked, said: (None, state),
            ("said", True): lambda state, asked, said: (self.clues[state]["success"], state + 1) if self._solves(state, said) else (None, state),
        }

    def _of(self, clue: int, field: str, missing: str) -> str:
        return self.clues.get(clue, {}).get(field, missing)

    def _solves(self, state: int, said: str) -> bool:
        return state in self.clues and re.search(self.clues[state]["answer_pattern"], said, re.IGNORECASE) is not None

    def step(self, state: int, content: str) -> tuple[str | None, int]:
        said = content.strip().lower()
        asked = _CLUE.match(said)
        kind = {"hunt": "start", "hint": "hint"}.get(said, "clue" if asked else "said")
        return self.rules[kind, state > 0](state, int(asked[1]) if asked else 0, said)


def hunt_replies(messages: DataFrame, intro: str, clues: list[dict], ttl: int = 86_400, key: str = "sender", bucket_seconds: int = 86_400) -> DataFrame:
    """(sender, id, ts, reply, state, next_state) of the messages that are part of the hunt.

    What can be neither a command nor an answer never reaches the fold.  A state older than ``ttl`` seconds is forgotten.
    A sender's messages are cut to pieces at the first command of each time bucket: a command gets a reply in any
    state.  Pieces are folded side by side from each of the few states there are; by sender, piece after piece, that tells
    the state in which each one begins, and with it the pieces are folded once more for their replies.
    """
    said = F.lower(strip(F.coalesce("content", F.lit(""))))
    command = said.isin("hunt", "hint") | said.rlike(r"^(?U)clue\s*\d+")
    answer = F.lit(False)
    for c in clues:
        answer = answer | said.rlike("(?i)" + c["answer_pattern"])
    kind = dict(messages.dtypes)
    df = messages.select(key, "id", "ts", F.col("content").cast("string").alias("content"), command.alias("_command"))
    df = df.where(F.col("_command") | answer).withColumn("_us", F.unix_micros("ts")).withColumn("_bucket", bucket(F.col("_us"), bucket_seconds))
    so_far = in_bucket(key).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_first", F.col("_command") & (F.count_if("_command").over(so_far) == 1))
    df = df.withColumn("_here", F.last(F.when(F.col("_first"), F.col("_us")), ignorenulls=True).over(so_far))
    each = df.groupBy(key, "_bucket").agg(F.max(F.when(F.col("_first"), F.col("_us"))).alias("cut"))
    df = carried(df, each, key, {"_earlier": F.last("cut", ignorenulls=True).over(before(key))})
    df = df.select(key, "id", "ts", "content", F.col("_us").alias("us"), F.coalesce("_here", "_earlier", F.lit(-(1 << 62))).alias("piece"))
    begins = _begins(df, intro, clues, ttl, key, kind[key])
    both = df.withColumns({"kind": F.lit(1), "begin": F.lit(0)}).unionByName(begins.withColumn("kind", F.lit(0)), allowMissingColumns=True)

    def fold() -> Callable[[tuple], tuple | None]:
        hunt, state, touched = Hunt(intro, clues), 0, None

        def step(r: tuple) -> tuple | None:
            nonlocal state, touched
            if r.kind == 0:
                state = int(r.begin)
                return None
            if touched is not None and r.ts.value // 1000 - touched > ttl * MICRO:
                state = 0
            before_it = state
            reply, state = hunt.step(state, r.content or "")
            if reply is None:
                return None
            touched = r.ts.value // 1000
            return (getattr(r, key), int(r.id), r.ts, reply, before_it, state)

        return step

    return fold_in_order(both, [key, "piece"], ["kind", "ts", "id"], fold, f"{key} {kind[key]}, id {kind['id']}, ts timestamp, reply string, state int, next_state int")


def _begins(rows: DataFrame, intro: str, clues: list[dict], ttl: int, key: str, key_type: str) -> DataFrame:
    """(key, piece, begin): the state in which each piece begins."""
    states = range(max((c["id"] for c in clues), default=0) + 2)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a piece: its first time, and for each state it may begin in the state and reply time it ends with (0: none)."""
        hunt, group, first = Hunt(intro, clues), None, 0
        now: dict[tuple[int, int], list[int]] = {}  # (state, reply time): the states it comes from
        done: list[tuple] = []

        def finish() -> None:
            if group is not None:
                end = {s: x for x, of in now.items() for s in of}
                done.append((*group, first, [end[s][0] for s in states], [end[s][1] for s in states]))

        for batch in batches:
            for r in batch.itertuples(index=False):
                here, us = (getattr(r, key), int(r.piece)), int(r.us)
                if here != group:
                    finish()
                    group, first, now = here, us, {(s, 0): [s] for s in states}
                after: dict[tuple[int, int], list[int]] = {}
                for (state, touched), of in now.items():
                    state = 0 if touched and us - touched > ttl * MICRO else state
                    reply, state = hunt.step(state, r.content or "")
                    after.setdefault((state, us if reply is not None else touched), []).extend(of)
                now = after
            yield pd.DataFrame(done, columns=[key, "piece", "first", "states", "times"])
            done.clear()
        finish()
        yield pd.DataFrame(done, columns=[key, "piece", "first", "states", "times"])

    dealt = rows.where(F.col("us").isNotNull()).select(key, "piece", "us", "id", "content").repartition(key, "piece").sortWithinPartitions(key, "piece", "us", "id")
    pieces = dealt.mapInPandas(ends, f"{key} {key_type}, piece long, first long, states array<int>, times array<long>")

    def chain() -> Callable[[tuple], tuple | None]:
        state, touched = 0, 0

        def step(r: tuple) -> tuple:
            nonlocal state, touched
            begin = 0 if touched and r.first - touched > ttl * MICRO else state
            state, touched = int(r.states[begin]), int(r.times[begin]) or touched
            return (getattr(r, key), r.piece, begin)

        return step

    return fold_in_order(pieces, [key], ["piece"], chain, f"{key} {key_type}, piece long, begin int")


def hunt_funnel(replies: DataFrame, intro: str, n_clues: int) -> DataFrame:
    """One row: starts, clues solved, completions."""
    solved = (F.col("next_state") > F.col("state")) & (F.col("state") > 0)
    return replies.agg(F.count_if(F.col("reply") == intro).alias("started"), F.count_if(solved).alias("clues_solved"), F.count_if(solved & (F.col("state") == n_clues)).alias("completed"))


def respond(prompts: DataFrame, make_responder: Callable[[], Callable[[list[list[dict]]], list[str]]], fallback: str) -> DataFrame:
    """(id, answer, ok) of (id, prompt) by a user's function over batches; a failing batch gets the fallback."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make_responder()
        for batch in batches:
            try:
                got, ok = answer([list(p) for p in batch["prompt"]]), True
            except Exception:  # noqa: BLE001  whatever the model raises, the sender gets a reply
                got, ok = [fallback] * len(batch), False
            yield pd.DataFrame({"id": batch["id"], "answer": got, "ok": ok})

    return prompts.select("id", "prompt").mapInPandas(run, f"id {dict(prompts.dtypes)['id']}, answer string, ok boolean")
