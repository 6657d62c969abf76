"""A stream gives the rows of the batch operators."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from relayloom.operators import dialog, rate, stats
from relayloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
CLUES = [{"id": i, "clue": f"c{i}", "answer_pattern": f"answer{i}", "success": f"s{i}", "hint": f"h{i}"} for i in (1, 2)]


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


@pytest.fixture(scope="module")
def rows():
    random.seed(7)
    out = [(i, random.choice("abc"), T0 + dt.timedelta(seconds=random.randrange(3000)), random.choice(["hunt", "hint", "clue 2", "answer1", "answer2", "hello"])) for i in range(120)]
    return out


SCHEMA = "id long, sender string, ts timestamp, content string"


def streamed(spark, tmp_path, rows, build, schema=SCHEMA, mode="append"):
    """Rows that ``build`` makes of two files read as a stream; a last row far ahead moves the watermark."""
    src = str(tmp_path / "src")
    far = [(10_000 + i, s, T0 + dt.timedelta(days=40), "hello", "")[: schema.count(",") + 1] for i, s in enumerate(["zz"])]
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :], far):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    name = "t" + uuid.uuid4().hex
    df = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(src))
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_traffic(rocks, tmp_path, rows):
    b = rocks.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in jobs.traffic(b, kind="content").collect()}
    got = {tuple(r) for r in streamed(rocks, tmp_path, rows, lambda s: jobs.traffic(s, kind="content")).where("start < '2024-01-05'").collect()}
    assert got == want


def test_sessions(rocks, tmp_path, rows):
    b = rocks.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in jobs.conversation_sessions(b, "120 seconds").collect()}
    got = {tuple(r) for r in streamed(rocks, tmp_path, rows, lambda s: jobs.conversation_sessions(s, "120 seconds")).where("sender <> 'zz'").collect()}
    assert got == want


def test_admission(rocks, tmp_path, rows):
    limits = [(60, 2), (600, 8)]
    want = {(r.sender, r.id, r.within_limits) for r in rate.admission(rocks.createDataFrame(rows, SCHEMA), limits).collect()}
    got = streamed(rocks, tmp_path, rows, lambda s: jobs.stateful(s, jobs.Admission(limits), "sender string, id long, within_limits boolean")).where("sender <> 'zz'")
    assert {tuple(r) for r in got.collect()} == want


def test_hunt(rocks, tmp_path, rows):
    want = {(r.sender, r.id, r.reply, r.state, r.next_state) for r in dialog.hunt_replies(rocks.createDataFrame(rows, SCHEMA), "intro", CLUES).collect()}
    got = streamed(rocks, tmp_path, rows, lambda s: jobs.stateful(s, jobs.Hunting("intro", CLUES), "sender string, id long, reply string, state int, next_state int"))
    assert {tuple(r) for r in got.where("sender <> 'zz'").collect()} == want


def test_history(rocks, tmp_path, rows):
    said = [(*r[:3], "/reset" if r[0] % 9 == 0 else r[3], f"re {r[0]}") for r in rows]
    schema = SCHEMA + ", reply string"
    b = dialog.sessions(rocks.createDataFrame(said, schema), 200).withColumn("reset", F.col("content") == "/reset")
    want = {(r.sender, r.id, tuple(map(tuple, r.history))) for r in dialog.visible_history(b, 4).collect()}
    got = streamed(rocks, tmp_path, said, lambda s: jobs.stateful(s, jobs.History(4, 200), jobs.History.SCHEMA), schema).where("sender <> 'zz'")
    assert {(r.sender, r.id, tuple(map(tuple, r.history))) for r in got.collect()} == want and any(h for _, _, h in want)


def test_node_table(rocks, tmp_path, rows):
    beats = [(r[1], r[2], r[0], None if r[0] % 2 else r[0] / 2, 1) for r in rows] + [("new", T0, 1, 1.0, 1)]
    schema = "node_id string, ts timestamp, messages_received long, avg_latency_ms double, rag_direct long"
    known = rocks.createDataFrame([("a",), ("b",), ("c",), ("zz",)], "node_id string")
    src = str(tmp_path / "beats")
    far = [("zz", T0 + dt.timedelta(days=40), 0, 0.0, 0)]
    for part in (beats[:60], beats[60:], far):
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    q = jobs.node_changes(rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), known).writeStream.format("memory").queryName("nodes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    table = {r.node_id: r for r in jobs.node_table(rocks.table("nodes")).collect()}
    last = {n: max((b for b in beats if b[0] == n), key=lambda b: b[1]) for n in "abc"}
    assert set(table) == {"a", "b", "c", "zz"} and table["zz"].status == "online"
    for n, b in last.items():
        assert table[n].status == "offline" and table[n].messages_received in {x[2] for x in beats if x[:2] == b[:2]}


def test_node_table_has_the_newest_metrics(rocks, tmp_path):
    """Exactly those of the latest heartbeat, nulls too, whichever file it comes in."""
    at = lambda n: T0 + dt.timedelta(seconds=n)
    beats = [("a", at(50), 5, 5.5, 1), ("b", at(10), 1, 1.5, 9), ("a", at(40), 4, 4.5, 2), ("b", at(30), 3, None, None), ("b", at(20), 2, 2.5, 8), ("x", at(20), 7, 7.5, 7)]
    schema, src = "node_id string, ts timestamp, messages_received long, avg_latency_ms double, rag_direct long", str(tmp_path / "beats")
    for part in (beats[:2], beats[2:], [("zz", at(40 * 86_400), 0, 0.0, 0)]):
        rocks.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    known = rocks.createDataFrame([("a",), ("b",), ("zz",)], "node_id string")
    q = jobs.node_changes(rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), known).writeStream.format("memory").queryName("newest_nodes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    table = {r.node_id: tuple(r)[2:] for r in jobs.node_table(rocks.table("newest_nodes")).collect()}
    assert table == {"a": ("offline", 5, 5.5, 1), "b": ("offline", 3, None, None), "zz": ("online", 0, 0.0, 0)}


def test_idle_state_goes(rocks, tmp_path, rows):
    late = rows + [(500 + i, "a", T0 + dt.timedelta(days=2, seconds=i), "hint") for i in range(3)]
    want = {(r.sender, r.id, r.reply, r.state, r.next_state) for r in dialog.hunt_replies(rocks.createDataFrame(late, SCHEMA), "intro", CLUES, 600).collect()}
    got = streamed(rocks, tmp_path, late, lambda s: jobs.stateful(s, jobs.Hunting("intro", CLUES, 600), "sender string, id long, reply string, state int, next_state int"))
    assert {tuple(r) for r in got.where("sender <> 'zz'").collect()} == want


def test_router_with_dead_letters_and_redelivery(rocks, tmp_path):
    src = str(tmp_path / "src")
    good = '{"sender": "1", "content": "fire", "timestamp": "2024-01-01T00:00:00"}'
    rocks.createDataFrame([(0, 0, good), (0, 1, "broken")], "partition int, offset long, value string").write.parquet(src)
    s = rocks.readStream.schema("partition int, offset long, value string").parquet(src)
    q = jobs.start_router(s, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination(60)
    assert [r.message_type for r in rocks.read.parquet(str(tmp_path / "good")).collect()] == ["emergency"]
    assert [r.raw for r in rocks.read.parquet(str(tmp_path / "dead")).collect()] == ["broken"]
    again = jobs.start_router(s, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "cp2"), availableNow=True)  # batch 0 once more
    again.awaitTermination(60)
    assert rocks.read.parquet(str(tmp_path / "good")).count() == rocks.read.parquet(str(tmp_path / "dead")).count() == 1


def test_deduplicated(rocks, tmp_path, rows):
    twice = rows + rows[:30]
    got = streamed(rocks, tmp_path, twice, lambda s: jobs.deduplicated(s, "ts", "2 hours")).where("sender <> 'zz'")
    assert got.count() == len(rows)


def test_admission_with_risk_is_the_batch_rule(rocks, tmp_path, rows):
    high = "Patient #12345 passport AB1234567 Card: 4111 1111 1111 1111"
    said = [(i, s, ts, high if i % 3 == 0 else c) for i, s, ts, c in rows]
    limits = [(60, 2), (600, 5)]
    got = streamed(rocks, tmp_path, said, lambda s: jobs.admitted(s, limits)).where("sender <> 'zz'")
    marked = jobs.understood(rocks.createDataFrame(said, SCHEMA)).withColumn("calm", F.col("risk_level") != "high")
    want = {(r.id, r.within_limits, r.recorded) for r in rate.admission(marked, limits, recordable="calm").collect()}
    assert {(r.id, r.within_limits, r.recorded) for r in got.collect()} == want
    assert any(w and not r for _, w, r in want) and not all(w for _, w, _ in want)


def test_router_table(rocks, tmp_path):
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    schema = "partition int, offset long, value string"
    good = lambda said: '{"sender": "1", "content": "%s", "timestamp": "2024-01-01T00:00:00"}' % said

    def run(checkpoint):
        q = jobs.start_router_table(rocks.readStream.schema(schema).parquet(src), table, str(tmp_path / checkpoint), availableNow=True)
        q.awaitTermination(60)
        assert q.exception() is None
        return sorted((r.id, r.readable, r.content, r.raw) for r in jobs.read_routed(rocks, table).collect())

    rocks.createDataFrame([(0, 0, good("fire")), (0, 1, "broken")], schema).coalesce(1).write.parquet(src)
    first = [("0-0", True, "fire", None), ("0-1", False, "", "broken")]
    assert run("cp") == first and run("cp") == first  # a restart writes nothing twice
    rocks.createDataFrame([(0, 2, good("hello"))], schema).coalesce(1).write.mode("append").parquet(src)
    more = [*first, ("0-2", True, "hello", None)]
    assert run("cp") == more
    assert run("other") == sorted(more * 2)  # another query adds to the table and loses nothing of it
    routed = jobs.read_routed(rocks, table)
    assert routed.where("id = '0-0'").first().message_type == "emergency" and routed.where("not readable and failed_at is null").count() == 0
    assert routed.where("readable").inputFiles() and "readable" in routed._jdf.queryExecution().optimizedPlan().toString()


def test_hourly_sketches_roll_up(rocks, tmp_path):
    r = random.Random(5)
    rows = [(i, r.choice("abc"), T0 + dt.timedelta(seconds=r.randrange(20_000)), str(int(r.expovariate(0.001)))) for i in range(6000)]
    batch = rocks.createDataFrame(rows, SCHEMA)
    kept = stats.sketched(batch, ["sender"], "content", "id")
    assert kept.where("n <> 0").count() == kept.select("start", "sender").distinct().count() > 6

    def near(got):
        for x in got.collect():
            mine = sorted(float(c) for _, s, _, c in rows if "sender" not in x or s == x.sender)
            assert x.n == len(mine) and abs(x["keys"] - len(mine)) < 0.06 * len(mine)
            for share, value in ((0.5, x.p50), (0.95, x.p95), (0.99, x.p99)):
                low, high = sum(v < value for v in mine) / len(mine), sum(v <= value for v in mine) / len(mine)
                assert low - 0.01 <= share <= high + 0.01

    near(stats.rolled_up(kept, ["sender"]))
    near(stats.rolled_up(kept, []))
    live = streamed(rocks, tmp_path, rows, lambda s: stats.sketched(s.withColumn("content", F.expr("try_cast(content as double)")), ["sender"], "content", "id", delay="1 day")).where("sender <> 'zz'")
    near(stats.rolled_up(live, ["sender"]))


def two_days(rows):
    """The rows, and later ones of the same senders a moment after; some senders only before or only after."""
    end = max(r[2] for r in rows)
    later = [(1000 + i, s if s != "c" else "d", end + (ts - T0) / 6 + dt.timedelta(seconds=1), *rest) for i, s, ts, *rest in rows[::2]]
    return later, rows + later


def test_admission_goes_on_from_a_table(rocks, tmp_path, rows):
    high = "Patient #12345 passport AB1234567 Card: 4111 1111 1111 1111"
    limits = [(600, 5), (60, 2)]
    later, both = two_days([(i, s, ts, high if i % 3 == 0 else c) for i, s, ts, c in rows])
    decide = lambda said: rate.admission(jobs.understood(rocks.createDataFrame(said, SCHEMA)).withColumn("calm", F.col("risk_level") != "high"), limits, recordable="calm")
    first = decide([r for r in both if r[0] < 1000])
    want = {(r.sender, r.id, r.within_limits, r.recorded) for r in decide(both).where("id >= 1000").collect()}
    got = streamed(rocks, tmp_path, later, lambda s: jobs.admitted(s, limits, decided=first)).where("sender <> 'zz'")
    assert {tuple(r) for r in got.collect()} == want
    alone = {(r.sender, r.id, r.within_limits, r.recorded) for r in decide(later).collect()}
    assert alone != want  # the table's days count


def test_hunt_goes_on_from_a_table(rocks, tmp_path, rows):
    later, both = two_days(rows)
    hunt = jobs.Hunting("intro", CLUES)
    replies = lambda said: dialog.hunt_replies(rocks.createDataFrame(said, SCHEMA), "intro", CLUES)
    names = ["sender", "id", "reply", "state", "next_state"]
    want = {tuple(r) for r in replies(both).where("id >= 1000").select(names).collect()}
    got = streamed(rocks, tmp_path, later, lambda s: jobs.stateful(s, hunt, "sender string, id long, reply string, state int, next_state int", initial=hunt.after(replies(rows)))).where("sender <> 'zz'")
    assert {tuple(r) for r in got.collect()} == want != {tuple(r) for r in replies(later).select(names).collect()}


def test_history_goes_on_from_a_table(rocks, tmp_path, rows):
    later, both = two_days([(*r[:3], "/reset" if r[0] % 9 == 0 else r[3], f"re {r[0]}") for r in rows])
    schema = SCHEMA + ", reply string"
    history = jobs.History(4, 200)

    def seen(said):
        return dialog.visible_history(dialog.sessions(rocks.createDataFrame(said, schema), 200).withColumn("reset", F.col("content") == "/reset"), 4)

    told = lambda df: {(r.sender, r.id, tuple(map(tuple, r.history))) for r in df.collect()}
    want = told(seen(both).where("id >= 1000"))
    got = streamed(rocks, tmp_path, later, lambda s: jobs.stateful(s, history, jobs.History.SCHEMA, initial=history.after(seen([r for r in both if r[0] < 1000]))), schema).where("sender <> 'zz'")
    assert told(got) == want != told(seen(later))
