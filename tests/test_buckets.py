"""Windows in time buckets equal the plain windows, and a hot sender takes more than one task."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relayloom.operators import dialog, rate
from relayloom.operators.buckets import bucket

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", params=[0, 1])
def turns(spark, request):
    """A hot sender with more than a third of the rows, others, a null sender and null times; ties in time."""
    r = random.Random(request.param)
    rows = []
    for i in range(600):
        sender = r.choice(["hot", "hot", "a", "b", "c", None])
        ts = None if r.random() < 0.02 else T0 + dt.timedelta(seconds=r.randrange(4000 if request.param else 90_000))
        rows.append((i, sender, ts, f"t{i}", r.choice([f"r{i}", None]), r.choice([True, False, False, False, False, None])))
    return spark.createDataFrame(rows, "id long, sender string, ts timestamp, content string, reply string, reset boolean").repartition(4)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in ("id", *columns)) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("edge", [False, True])
def test_rate_counts(turns, edge):
    windows = {"short": 30, "long": 600}
    plain = turns.withColumn("_us", F.unix_micros("ts"))
    for name, s in windows.items():
        plain = plain.withColumn(name, F.count("*").over(Window.partitionBy("sender").orderBy("_us").rangeBetween(-s * 1_000_000 + (0 if edge else 1), 0)) - 1)
    got = rate.rate_counts(turns, windows, edge=edge)
    assert rows_of(got, *windows) == rows_of(plain, *windows) and got.columns == [*turns.columns, *windows]


def plain_sessions(turns, gap):
    w = Window.partitionBy("sender").orderBy("ts", "id")
    idle = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) > gap * 1_000_000
    return turns.withColumn("_new", F.coalesce(idle, F.lit(False)).cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


@pytest.mark.parametrize(("gap", "seconds"), [(20, 60), (100, 60), (300, 3600), (900, 86_400)])
def test_sessions(turns, gap, seconds):
    got = dialog.sessions(turns, gap, bucket_seconds=seconds)
    assert rows_of(got, "session") == rows_of(plain_sessions(turns, gap), "session") and got.columns == [*turns.columns, "session"]


@pytest.mark.parametrize(("n", "seconds"), [(3, 60), (10, 600), (1, 3600), (4, 86_400)])
def test_visible_history(turns, n, seconds):
    df = plain_sessions(turns, 300)
    part = F.sum(F.coalesce("reset", F.lit(False)).cast("int")).over(Window.partitionBy("sender").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    turn = F.when(~F.coalesce("reset", F.lit(False)), F.struct(F.col("content").alias("user"), F.col("reply").alias("assistant")))
    plain = df.withColumn("_part", part).withColumn("history", F.collect_list(turn).over(Window.partitionBy("sender", "session", "_part").orderBy("ts", "id").rowsBetween(-n, -1)))
    got = dialog.visible_history(df, n, bucket_seconds=seconds)
    assert rows_of(got, "history") == rows_of(plain, "history") and got.columns == [*df.columns, "history"]


def busy_tasks(df, sender="hot"):
    """Tasks that hold rows of the sender at the end of the plan."""
    return df.where(F.col("sender") == sender).select(F.spark_partition_id().alias("p")).distinct().count()


def test_a_hot_sender_takes_more_than_one_task(spark, turns):
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "16"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        known = turns.where("ts is not null")
        days = known.select(bucket(F.unix_micros("ts"), 3600).alias("b")).where("b is not null").distinct().count()
        assert days >= 2
        s = dialog.sessions(known, 300, bucket_seconds=3600)
        assert busy_tasks(rate.rate_counts(known, {"n": 300})) > 1 and busy_tasks(s) > 1
        assert busy_tasks(dialog.visible_history(s, 3, bucket_seconds=3600)) > 1
        plan = dialog.last_turns(s, 2)._jdf.queryExecution().executedPlan().toString()
        assert "row_number(), 2, Partial" in plan  # a task keeps two turns a session before the shuffle
    finally:
        for name, value in (("spark.sql.adaptive.enabled", "true"), ("spark.sql.shuffle.partitions", "3"), ("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))):
            spark.conf.set(name, value)


def plain_admission(rows, limits, edge=False):
    """(id -> within, recorded) by one fold a sender over (id, sender, ts, ok)."""
    out, folds = {}, {}
    for i, sender, ts, ok in sorted(rows, key=lambda r: (r[2] is None, r[2] or T0, r[0])):
        if ts is None:
            out[i] = (True, bool(ok))
        else:
            fold = folds.setdefault(sender, rate.Limiter(limits, edge))
            out[i] = fold.step(round((ts - T0).total_seconds() * 1_000_000), bool(ok))
    return out


@pytest.mark.parametrize("edge", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_admission_in_pieces_is_the_single_fold(spark, seed, edge):
    r = random.Random(seed)
    limits = [(10, 2), (30, 4)]
    # Every 7 seconds or so without a pause: a limit of 2 in 10 seconds keeps a rhythm that a wrong begin would shift for good.
    hot = [(i, "hot", T0 + dt.timedelta(seconds=r.choice([3, 7]) * i * (0.5 if seed else 1)), r.random() < 0.9) for i in range(400)]
    more = [(1000 + i, r.choice(["a", "b", "", None]), r.choice([None, T0 + dt.timedelta(seconds=r.randrange(2000) / 2)]), r.choice([True, None])) for i in range(200)]
    rows = hot + more
    df = spark.createDataFrame(rows, "id long, sender string, ts timestamp, ok boolean").repartition(4)
    got = rate.admission(df, limits, recordable="ok", edge=edge, piece_windows=2, piece_rows=r.choice([0, 100]))
    assert {x.id: (x.within_limits, x.recorded) for x in got.collect()} == plain_admission(rows, limits, edge)
    assert got.columns == [*df.columns, "within_limits", "recorded"]


def test_a_run_without_a_pause_is_folded_in_several_tasks(spark):
    df = spark.range(2000).select("id", F.lit("hot").alias("sender"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = rate.admission(df, [(10, 3)], piece_windows=8, piece_rows=1000)
        spread = got.groupBy(F.spark_partition_id()).count().collect()
        assert len(spread) > 1 and got.where("recorded").count() == 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_texts_are_screened_once(spark):
    from relayloom.operators import privacy

    m = spark.createDataFrame([(i, "a", T0 + dt.timedelta(seconds=i), "call 555-123-4567") for i in range(30)], "id long, sender string, ts timestamp, content string")
    blocked = spark.createDataFrame([("b", "spam")], "phone_number string, reason string")
    got = privacy.message_verdicts(m, blocked, [(60, 2)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and got.where("valid").count() == 2


def test_histories_in_blocks(spark, turns):
    df = turns.withColumn("role", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant"))
    rows = sorted((r for r in df.collect()), key=lambda r: (r.ts is not None, r.ts or T0, r.id))
    said = {}
    for r in rows:
        said.setdefault(r.sender, []).append((r.role, r.content))
    blocks = dialog.history_blocks(df, 7, bucket_seconds=600)
    got = {(b.sender, b.block): [tuple(t) for t in b.turns] for b in blocks.collect()}
    assert got == {(s, n): t[7 * n : 7 * n + 7] for s, t in said.items() for n in range(-(-len(t) // 7))}
    assert blocks.where("n > 7 or n <> size(turns)").count() == 0 and len(said["hot"]) > 100
    assert {r.sender: [tuple(t) for t in r.history] for r in dialog.newest_history(blocks, 10, 7).collect()} == {s: t[-10:] for s, t in said.items()}
    assert {r.sender: [tuple(t) for t in r.history] for r in dialog.history_arrays(df).collect()} == said


@pytest.mark.parametrize("seed", range(3))
def test_a_hunt_in_pieces_is_the_single_fold(spark, seed):
    r = random.Random(seed)
    clues = [{"id": i, "clue": f"c{i}", "answer_pattern": f"answer{i}", "success": f"s{i}", "hint": f"h{i}"} for i in (1, 2, 3)]
    said = ["answer1", "answer2", "answer3", "hint", "clue 2", "CLUE 3", "nothing", None] * 3 + ["HUNT"] * (1 + seed)
    rows = [(i, r.choice(["hot", "hot", "a", None]), T0 + dt.timedelta(seconds=r.randrange(40_000)), r.choice(said)) for i in range(500)]
    want = []
    for sender in {s for _, s, _, _ in rows}:
        hunt, state, touched = dialog.Hunt("intro", clues), 0, None
        for i, _, ts, content in sorted((x for x in rows if x[1] == sender), key=lambda x: (x[2], x[0])):
            if touched is not None and (ts - touched).total_seconds() > 900:
                state = 0
            old = state
            reply, state = hunt.step(state, content or "")
            if reply is not None:
                touched = ts
                want.append((i, sender, reply, old, state))
    df = spark.createDataFrame(rows, "id long, sender string, ts timestamp, content string").repartition(4)
    got = dialog.hunt_replies(df, "intro", clues, ttl=900, bucket_seconds=1800)
    assert sorted((x.id, x.sender, x.reply, x.state, x.next_state) for x in got.collect()) == sorted(want, key=lambda x: x[0])
    assert {x[3] for x in want} >= {0, 1, 2}
