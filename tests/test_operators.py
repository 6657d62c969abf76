"""Golden rows of the single operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from relayloom.operators import corpus, dialog, evaluate, fleet, privacy, rate, search, stats, text
from relayloom.sources import messages

T0 = dt.datetime(2024, 1, 1)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def column(spark, texts, name="content"):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"id long, {name} string")


def test_route_class(spark):
    cases = {
        "There is a fire in hall B": ("emergency", "emergency", False), "help someone is injured": ("emergency", "emergency", False), "we need medical assistance": ("emergency", "emergency", False),
        "/help": ("command", "normal", False), "hello": ("template", "low", False), " Good Morning ": ("template", "low", False), "What sessions are about edge computing?": ("query", "normal", True), "fire!": ("query", "normal", True),
        "an active shooter": ("emergency", "emergency", False), "": ("query", "normal", True), None: ("query", "normal", True),
    }
    got = text.route_class(column(spark, list(cases))).orderBy("id").collect()
    assert [(r.message_type, r.priority, r.requires_rag) for r in got] == list(cases.values())


def test_parse(spark):
    cases = {"help there is a fire emergency": "emergency", "what sessions are about AI?": "question", "hello": "greeting", "search for edge computing": "command", "xyzzy": "unknown", "which room?": "greeting", "?": "question", "   ": "unknown", "\U0001f600 中文 \x00 <b>": "unknown"}
    got = text.parse(column(spark, list(cases))).orderBy("id").collect()
    assert [r.intent for r in got] == list(cases.values())
    r = text.parse(column(spark, ["call 555-123-4567 or a@b.org about the weather forecast 2024-05-01"])).first()
    assert r.us_phones[0].asDict() == {"area": "555", "exchange": "123", "line": "4567"} and r.emails == ["a@b.org"] and r.dates == ["2024-05-01"] and r.category == "weather" and r.priority == "high" and r.locations == []


def test_category_works_its_text_out_once(spark):
    said = [None, "", "no word of these", "BUS news", "the busy storm", "wea\x00ther", "wea\u20acther", "wea\u00a0ther", "wea ther", "wea-ther", "Studying law", "\u2003Permit.", "licence", "trains and trainers", "x" * 5000 + "FLIGHT"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string").repartition(2)
    want = ["general", "general", "general", "news", "weather", "weather", "weather", "general", "general", "general", "education", "government", "general", "weather", "transport"]
    made = text.clean_text(F.col("text"))
    got = d.select("doc_id", text.category(made).alias("category"))
    assert [r.category for r in got.orderBy("doc_id").collect()] == want  # "trains" holds "rain"
    kept = d.select("doc_id", made.alias("clean")).localCheckpoint()
    assert [r.category for r in kept.select("doc_id", text.category(F.col("clean")).alias("category")).orderBy("doc_id").collect()] == want
    patterns = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    assert patterns(got) == 2  # not inside of the search for each word


def test_validate(spark):
    got = text.validate(column(spark, ["x" * 160, "x" * 161, "", "Free! Win a prize now."])).orderBy("id").collect()
    assert [r.valid for r in got] == [True, False, False, True]
    assert got[1].errors == ["Message too long: 161 characters (max 160)"] and got[2].errors == ["Message is empty"] and len(got[3].warnings) == 1


def test_split_and_truncate(spark):
    cut = lambda t, limit=160: column(spark, [t]).select(text.sms_parts(F.col("content"), limit).alias("p")).first().p
    assert cut("short") == ["short"]
    assert [len(p) for p in cut("word " * 60)] == [155, 156]
    assert [len(p) for p in cut("x" * 400)] == [158, 158, 102]
    assert cut("aa bb  cc dddddddddddd", 12) == ["aa (1/6)", "bb (2/6)", "cc (3/6)", "dddd (4/6)", "dddd (5/6)", "dddd (6/6)"]
    assert cut(" " + "x" * 20, 18)[0] == " (1/3)" and cut("x" * 10 + " " * 9, 18) == ["x" * 10] and cut("x" * 155 + " " * 9) == ["x" * 152 + " (1/2)", "xxx          (2/2)"]
    rows = text.split_sms(column(spark, ["x" * 400, None], "reply")).orderBy("id", "part_no").collect()
    assert [(r.part_no, r.part_count) for r in rows] == [(1, 3), (2, 3), (3, 3), (1, 1)] and rows[0].part.endswith(" (1/3)")
    assert [len(r.t) for r in column(spark, ["x" * 160, "x" * 161]).select(text.truncate(F.col("content")).alias("t")).collect()] == [160, 160]


PII = [
    ("Call 555-123-4567 for info", 5, "low", "Call [PHONE_REDACTED] for info"), ("My SSN is 123-45-6789", 10, "low", "My SSN is [SSN_REDACTED]"), ("Card: 4111 1111 1111 1111", 10, "low", "Card: [CREDIT_CARD_REDACTED]"),
    ("Patient #12345 passport AB1234567", 20, "medium", "[MEDICAL_ID_REDACTED] passport [PASSPORT_REDACTED]"), ("acct 123456789 at 12 Oak street", 25, "high", "acct [SSN_REDACTED] at [ADDRESS_REDACTED]"),
    ("Summit Connect is a great conference about edge AI", 0, "low", "Summit Connect is a great conference about edge AI"),
]


def test_pii(spark):
    df = privacy.pii_scan(column(spark, [p[0] for p in PII])).withColumn("redacted", privacy.redact(F.col("content"))).orderBy("id")
    assert [(r.content, r.risk_score, r.risk_level, r.redacted) for r in df.collect()] == PII


def events(spark, rows):
    return spark.createDataFrame(rows, "id long, sender string, ts timestamp")


def test_rate_edges(spark):
    m = events(spark, [(1, "a", at(0)), (2, "a", at(60)), (3, "a", at(60.5)), (4, "b", at(0))])
    inside = {r.id: r.n for r in rate.rate_counts(m, {"n": 60}).collect()}
    assert inside == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.id: r.n for r in rate.rate_counts(m, {"n": 60}, edge=True).collect()}[2] == 1
    fold = lambda times, limits, edge=False: [one.step(t * 1_000_000, True)[0] for one in [rate.Limiter(limits, edge)] for t in times]
    assert fold(range(4), [(60, 3)]) == [True, True, True, False]
    assert fold([0, 61], [(60, 1)]) == fold([0, 60], [(60, 1)]) == [True, True] and fold([0, 60], [(60, 1)], True) == [True, False]


def test_admission_is_the_fold(spark):
    random.seed(3)
    rows = [(i, random.choice("abc"), at(random.randrange(400) * 0.5)) for i in range(300)]
    got = {r.id: r.within_limits for r in rate.admission(events(spark, rows), [(10, 3), (60, 8)]).collect()}
    want = {}
    for s in "abc":
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[2], r[0]))
        kept: list[dt.datetime] = []
        for i, _, ts in mine:
            ok = all(sum((ts - k).total_seconds() < w for k in kept) < most for w, most in ((10, 3), (60, 8)))
            want[i] = ok
            if ok:
                kept.append(ts)
    assert got == want and not all(want.values())


def test_verdict_and_lists(spark):
    e = spark.createDataFrame([("1", "block", "spam", at(0)), ("1", "unblock", "ok", at(9)), ("2", "block", "spam", at(3))], "phone_number string, action string, reason string, ts timestamp")
    assert [r.phone_number for r in privacy.current_blocklist(e).collect()] == ["2"]
    v = spark.createDataFrame([(True, False, "high"), (False, False, "high"), (False, True, "high"), (False, True, "low")], "blocked boolean, within_limits boolean, risk_level string")
    assert [r.reason for r in privacy.verdict(v).collect()] == ["user_blocked", "rate_limit_exceeded", "high_risk_content", "valid"]


def test_consent(spark):
    c = spark.createDataFrame([("1", ["contact"], at(10), True), ("1", ["health"], at(99), True), ("2", ["contact"], at(99), False)], "phone_number string, data_categories array<string>, expires_at timestamp, is_active boolean")
    q = spark.createDataFrame([(1, "1", at(5), ["contact"]), (2, "1", at(10), ["contact"]), (3, "1", at(5), ["other"]), (4, "2", at(5), ["contact"])], "id long, phone_number string, ts timestamp, categories array<string>")
    assert [r.id for r in privacy.consented(q, c).collect()] == [1]


def test_audit_sink(spark, tmp_path):
    d = spark.createDataFrame([(at(1), "valid", "1"), (at(2), "blocked", "2")], "ts timestamp, reason string, sender string")
    for _ in range(2):
        privacy.append_audit(privacy.audit_rows(d, "validated", ["reason", "sender"]), str(tmp_path / "audit"))
    back = spark.read.parquet(str(tmp_path / "audit"))
    assert back.count() == 4 and privacy.newest_audit(back, 1).first().details["reason"] == "blocked"


@pytest.mark.parametrize(("length", "n"), [(0, 1), (600, 1), (601, 2), (1080, 2), (1081, 3)])
def test_chunks(spark, length, n):
    d = spark.createDataFrame([("d", "x" * length, "h")], "id string, text string, content_hash string")
    rows = corpus.chunks(d).orderBy("chunk_index").collect()
    assert len(rows) == n == rows[0].chunk_count and rows[0].chunk_id == "d::chunk::0"


def test_export_import(spark, tmp_path):
    d = spark.createDataFrame([("a", "old"), ("b", "kept")], "id string, text string")
    corpus.export_documents(spark.createDataFrame([("a", "new"), ("c", "more")], "id string, text string"), str(tmp_path / "x"))
    assert {(r.id, r.text) for r in corpus.import_documents(d, str(tmp_path / "x")).collect()} == {("a", "new"), ("b", "kept"), ("c", "more")}


def test_sessions_history_and_reset(spark):
    t = spark.createDataFrame([(1, "a", at(0), "x", "r", False), (2, "a", at(3600), "y", "r", False), (3, "a", at(7201), "z", "r", False), (4, "a", at(7202), "/reset", "r", True), (5, "a", at(7203), "w", "r", False)], "id long, sender string, ts timestamp, content string, reply string, reset boolean")
    h = {r.id: [x.user for x in r.history] for r in dialog.visible_history(dialog.sessions(t)).collect()}
    assert h == {1: [], 2: ["x"], 3: [], 4: [] if h[4] == [] else ["z"], 5: []}


CLUES = [{"id": i, "clue": f"c{i}", "answer_pattern": p, "success": f"s{i}", "hint": f"h{i}"} for i, p in enumerate(("bitnet", "red ?hat", "400"), 1)]


def test_hunt(spark):
    said = ["CLUE 1", "HINT", "hunt\n", "CLUE 3", "nothing", "It is BitNet", "hint", "red hat", "400", "clue 4", "HUNT"]
    rows = [(i, "a", at(i), c) for i, c in enumerate(said)] + [(99, "b", at(1), "bitnet")]
    m = spark.createDataFrame(rows, "id long, sender string, ts timestamp, content string")
    got = dialog.hunt_replies(m, "intro", CLUES).orderBy("id").collect()
    assert [(r.id, r.next_state) for r in got] == [(0, 0), (1, 0), (2, 1), (3, 1), (5, 2), (6, 2), (7, 3), (8, 4), (9, 4), (10, 1)]
    assert got[3].reply.startswith("You haven't unlocked Clue 3") and got[8].reply == "Clue not found."
    f = dialog.hunt_funnel(dialog.hunt_replies(m, "intro", CLUES), "intro", 3).first()
    assert (f.started, f.clues_solved, f.completed) == (2, 3, 1)


TRUTH = [("test_01", "When is the keynote?", "schedule", ["keynote", "9:00", "main hall"], ["i don't know"], ["Day 1"], 15000.0)]


def test_score(spark):
    good = "The keynote is at 9:00 in Main Hall on Day 1."
    cases = [(good, 500.0), (good.upper(), 500.0), ("", 500.0), ("The keynote starts in the morning.", 500.0), (good + "x" * 160, 500.0), ("I don't know about the keynote", 500.0), (good, 15000.0), (good, 22500.0), (good, 30000.0)]
    r = spark.createDataFrame([(i, "test_01", t, ms) for i, (t, ms) in enumerate(cases)] + [(99, "nope", "x", 1.0)], "rid long, query_id string, response string, latency_ms double")
    truth = spark.createDataFrame(TRUTH, "id string, query string, category string, expected_keywords array<string>, forbidden_keywords array<string>, expected_entities array<string>, max_acceptable_latency_ms double")
    joined, unknown = evaluate.with_truth(r.join(evaluate.repetition(r, "rid"), "rid"), truth)
    assert [x.rid for x in unknown.collect()] == [99]
    s = {x.rid: x for x in evaluate.score(joined).collect()}
    assert s[0].composite_score == 1.0 and s[0]["pass"] and s[1].keyword_score == s[1].entity_score == 1.0
    assert (s[2].keyword_score, s[2].entity_score, s[2].forbidden_score, s[2].length_score) == (0, 0, 1, 1) and s[2].composite <= 0.5
    assert abs(s[3].keyword_score - 1 / 3) < 1e-9 and s[4].length_score == 0 and s[5].forbidden_score == 0
    assert [s[i].latency_score for i in (6, 7, 8)] == [1.0, 0.5, 0.0]


def test_score_with_weights(spark):
    """Weights count by their share of the sum, dimensions without one not at all; with a sum of zero nothing counts."""
    cases = [("The keynote starts in the morning.", 500.0), ("I don't know", 22500.0)]
    r = spark.createDataFrame([(i, "test_01", t, ms) for i, (t, ms) in enumerate(cases)], "rid long, query_id string, response string, latency_ms double")
    truth = spark.createDataFrame(TRUTH, "id string, query string, category string, expected_keywords array<string>, forbidden_keywords array<string>, expected_entities array<string>, max_acceptable_latency_ms double")
    joined, _ = evaluate.with_truth(r.join(evaluate.repetition(r, "rid"), "rid"), truth)
    told = lambda w: {x.rid: (x.composite_score, x["pass"]) for x in evaluate.score(joined, w).collect()}
    assert told({"keyword": 3, "latency": 1}) == {0: (0.5, True), 1: (0.125, False)}
    assert told({"forbidden": 0.2, "latency": 0.2}) == {0: (1.0, True), 1: (0.25, False)}
    assert told({"keyword": 0, "entity": 0}) == {0: (0.0, False), 1: (0.0, False)}
    assert told(None) == told({"keyword": 25, "entity": 25, "forbidden": 15, "length": 10, "latency": 10, "repetition": 15})


def test_repetition(spark):
    r = {x.id: x.repetition for x in evaluate.repetition(column(spark, ["all words differ here today", "", "a b", "the keynote " * 8], "response")).collect()}
    assert r[0] == r[1] == r[2] == 1.0 and abs(r[3] - 0.1381) < 1e-9


def test_percentiles_and_degradation(spark):
    s = spark.createDataFrame([(1, float(x), True) for x in (100, 200, 300, 400)], "burst_size int, total_ms double, ok boolean")
    r = stats.latency_percentiles(s, "burst_size").first()
    assert (r.p50_ms, r.p95_ms, r.p99_ms) == (250.0, 385.0, 397.0)
    curve = spark.createDataFrame([(1, 100.0), (2, 79.0), (5, 80.0)], "burst_size int, p95_ms double")
    assert [x.ok for x in stats.degradation(curve).orderBy("burst_size").collect()] == [True, False, True]


def test_fleet(spark):
    reg = spark.createDataFrame([("a", "u", at(0)), ("b", "u", at(1))], "node_id string, api_url string, ts timestamp")
    beat = spark.createDataFrame([("a", at(40), 5, 10.0, 1), ("b", at(41), 7, None, 2), ("x", at(41), 9, 1.0, 3)], "node_id string, ts timestamp, messages_received long, avg_latency_ms double, rag_direct long")
    nodes, rejected = fleet.fleet_state(reg, beat, F.lit(at(100)).cast("timestamp"))
    assert {r.node_id: r.status for r in nodes.collect()} == {"a": "offline", "b": "online"} and [r.node_id for r in rejected.collect()] == ["x"]
    s = fleet.fleet_summary(nodes).first()
    assert (s.nodes, s.online, s.messages, s.mean_latency_ms, s.direct) == (2, 1, 12, 10.0, 3)
    load = spark.createDataFrame([("a", at(0), 1.0), ("b", at(0), 1.0), ("a", at(30), 5.0)], "node_id string, ts timestamp, load double")
    known = spark.createDataFrame([("a", 2), ("b", 1)], "node_id string, registered_at long")
    m = spark.createDataFrame([(1, at(0)), (2, at(59)), (3, at(60)), (4, at(500))], "id long, ts timestamp")
    assert {r.id: r.node_id for r in fleet.route_to_nodes(m, load, known).collect()} == {1: "b", 2: "b", 3: "a", 4: None}


def test_combine_and_route(spark):
    schema = "query_id long, document string, score double, metadata map<string,string>"
    v = spark.createDataFrame([(1, "x", 0.8, {"s": "v"}), (1, "y", 0.4, {"s": "v"})], schema)
    t = spark.createDataFrame([(1, "x", 15.0, {"s": "t"}), (1, "z", 9.0, {"s": "t"})], schema)
    rows = search.combine(v, t).orderBy("rank").collect()
    assert [(r.document, r.score, r.metadata["s"]) for r in rows] == [("x", 1.0, "v"), ("z", 0.6, "t")]
    h = spark.createDataFrame([(1, "short", 0.7, 1), (2, "l" * 161, 0.9, 1), (3, "short", 0.69, 1)], "query_id long, document string, score double, rank int")
    assert {r.query_id: r.route for r in search.answer_route(h).collect()} == {1: "direct", 2: "model", 3: "model"}


def test_responder_falls_back(spark):
    p = column(spark, ["x", "y"]).select("id", text.prompt("s", F.lit(None), F.col("content")).alias("prompt"))

    def good():
        return lambda prompts: [q[-1]["content"].upper() for q in prompts]

    def bad():
        def fail(prompts):
            raise RuntimeError("down")

        return fail

    assert sorted(r.answer for r in dialog.respond(p, good, "sorry").collect()) == ["X", "Y"]
    assert {(r.answer, r.ok) for r in dialog.respond(p, bad, "sorry").collect()} == {("sorry", False)}


def test_decode_and_encode(spark):
    good = '{"sender": "1", "receiver": "2", "content": "hi", "timestamp": "2024-01-01T00:00:00", "priority": "HIGH", "metadata": "{\\"k\\": \\"v\\"}"}'
    rows = [(0, 5, good), (0, 6, '{"priority": "what", "metadata": "no json"}'), (1, 0, "broken"), (1, 1, None)]
    got = messages.decode(spark.createDataFrame(rows, "partition int, offset long, value string")).orderBy("id").collect()
    assert [r.id for r in got] == ["0-5", "0-6", "1-0", "1-1"] and [r.ok for r in got] == [True, True, False, False]
    assert (got[0].priority, got[0].metadata) == ("high", {"k": "v"}) and (got[1].sender, got[1].receiver, got[1].content, got[1].priority, got[1].metadata) == ("unknown", "system", "", "normal", None)
    m = messages.decode(spark.createDataFrame(rows[:1], "partition int, offset long, value string"))
    again = messages.encode(m).selectExpr("0 as partition", "5 as offset", "value")
    assert messages.decode(again).drop("raw").first() == m.drop("raw").first()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_search_beyond_a_block_of_queries(spark, monkeypatch, metric):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(700)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(3)
    q = v.withColumnRenamed("doc_id", "query_id")
    want = {(x.query_id, x.doc_id, round(x.distance, 6), x["rank"]) for x in search.vector_search(q, v, 3, metric).collect()}
    for name, value in {"QUERY_BLOCK": 50, "PIECE": 16, "HELD": 2}.items():
        monkeypatch.setattr(search, name, value, raising=False)
    got = {(x.query_id, x.doc_id, round(x.distance, 6), x["rank"]) for x in search.vector_search(q, v, 3, metric).collect()}
    assert got == want and len(got) == 2100
    if metric == "l2":
        for i, a in rows[:40]:
            near = sorted((sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), j) for j, b in rows)[:3]
            assert {(j, d) for _, j, d, _ in (g for g in got if g[0] == i)} == {(j, d) for d, j in near}


def test_vector_search_with_a_filter(spark):
    v = spark.createDataFrame([(1, [0.0], {"c": "a"}), (2, [1.0], {"c": "b", "d": "x"}), (3, [2.0], None)], "doc_id long, vector array<double>, metadata map<string,string>")
    q = spark.createDataFrame([(1, [0.0], {"c": "b"}), (2, [2.0], None), (3, [0.0], {"c": "b", "d": "y"})], "query_id long, vector array<double>, filter map<string,string>")
    assert sorted((r.query_id, r.doc_id, r.distance) for r in search.vector_search(q, v, 1).collect()) == [(1, 2, 1.0), (2, 3, 0.0)]


def test_keyword_search(spark, monkeypatch):
    d = spark.createDataFrame([(1, "Edge talk", "edge one and edge one", ["edge", "talk"], "x"), (2, None, "the hedge", ["hedge"], "y"), (3, "t", None, None, "x")], "doc_id long, title string, text string, keywords array<string>, category string")
    q = spark.createDataFrame([(1, "EDGE one", None), (2, "edge", "y"), (3, " ", None), (4, "zzz", None)], "query_id long, query string, category string")
    want = {(1, 1, 11), (1, 2, 1), (2, 2, 8)}
    assert {(r.query_id, r.doc_id, r.score) for r in search.keyword_search(q, d).collect()} == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    assert {(r.query_id, r.doc_id, r.score) for r in search.keyword_search(q, d).collect()} == want


def test_corpus_files(spark, tmp_path):
    files = {
        "schedule": '{"conference": "Conf", "dates": "May 1", "location": "Hall", "days": [{"date": "2026-05-01", "label": "Day 1", "blocks": [{"time": "07:00-08:30", "title": "Tea", "location": "Lobby"}, {"time": "09:00-10:00", "title": "Talk", "location": "A", "speaker": "Ann"}]}]}',
        "sessions": '{"sessions": [{"id": "S1", "title": "T", "track": "K", "day": 2, "time": "9-10", "room": "A1", "type": "lab", "speakers": ["P1"], "description": "100% fun."}]}',
        "speakers": '{"speakers": [{"id": "P1", "name": "Ann", "title": "Eng", "company": "Co", "bio": "Bio.", "sessions": ["S1", "S2"]}]}',
        "venues": '{"main_venue": {"name": "C", "address": "1 St", "levels": [{"level": 1, "areas": ["a", "b"]}, {"level": "Roof", "areas": ["c"]}], "amenities": ["w", "x"]}, "hotels": [{"name": "Big Inn", "distance": "1 mile", "shuttle": true, "rate": "$9"}, {"name": "Inn", "distance": "2", "shuttle": false, "rate": "$1"}], "restaurants": [{"name": "Eat", "cuisine": "Thai", "distance": "3", "price": "$"}], "transport": {"shuttle": "S.", "rideshare": "R.", "parking": "P.", "public_transit": "B."}}',
        "city": '{"city": "Town", "weather": {"july_average_high": "9", "july_average_low": "1", "conditions": "Sun."}, "emergency": {"event_security": "5", "first_aid": "L", "local_emergency": "911", "nearest_hospital": "H", "pharmacy": "D"}, "attractions": [{"name": "The Park", "type": "Out", "distance": "1", "description": "Green."}], "tips": ["Walk.", "Sip."]}',
        "architecture": '{"architecture": [{"id": "a1", "text": "One.", "category": "x"}, {"id": "a2", "text": "Two."}]}',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.doc_id: (r.text, r.metadata) for r in corpus.corpus_documents({n: corpus.read_corpus(spark, str(tmp_path / f"{n}.json"), n) for n in files}).collect()}
    assert got == {
        "schedule_overview": ("Conf runs May 1 at Hall.", {"category": "schedule", "priority": "high"}),
        "sched_2026-05-01_0700_0830": ("Day 1 — 07:00-08:30: Tea. Location: Lobby.", {"category": "schedule", "day": "2026-05-01"}),
        "sched_2026-05-01_0900_1000": ("Day 1 — 09:00-10:00: Talk. Location: A. Presented by Ann.", {"category": "schedule", "day": "2026-05-01"}),
        "S1": ("Session: T. Track: K. Day 2, 9-10, Room A1. Type: lab. 100% fun.", {"category": "sessions", "track": "K", "type": "lab"}),
        "P1": ("Speaker: Ann, Eng at Co. Bio. Speaking at 2 session(s).", {"category": "speakers", "company": "Co"}),
        "venue_main": ("Main venue: C, 1 St. Amenities: w; x.", {"category": "venue"}), "venue_level_1": ("Level 1: a, b.", {"category": "venue"}), "venue_level_Roof": ("Level Roof: c.", {"category": "venue"}),
        "hotel_big_inn": ("Hotel: Big Inn, 1 mile from venue. Shuttle available. $9.", {"category": "hotels"}), "hotel_inn": ("Hotel: Inn, 2 from venue.  $1.", {"category": "hotels"}),
        "food_eat": ("Restaurant: Eat (Thai), 3 from venue. Price: $.", {"category": "food"}), "transport_info": ("Transport: S. R. P. B.", {"category": "transport"}),
        "city_weather": ("Weather in Town: July average high 9, low 1. Sun.", {"category": "weather"}),
        "city_emergency": ("Emergency: Event security — 5. First aid at L. Local emergency: 911. Nearest hospital: H. Pharmacy: D.", {"category": "emergency", "priority": "high"}),
        "attraction_the_park": ("The Park (Out), 1 from venue: Green.", {"category": "attractions"}), "tip_0": ("Walk.", {"category": "tips"}), "tip_1": ("Sip.", {"category": "tips"}),
        "a1": ("One.", {"category": "x"}), "a2": ("Two.", {"category": "architecture"}),
    }


def test_hunt_keeps_the_state_that_a_restart_ends(spark):
    said = [(0, 0, "hunt"), (1, 1, "bitnet"), (2, 2, "HUNT\n"), (3, 100_000, "hunt"), (4, 100_001, "red hat"), (5, 200_000, "bitnet")]
    m = spark.createDataFrame([(i, "a", at(s), c) for i, s, c in said], "id long, sender string, ts timestamp, content string")
    assert [(r.id, r.state, r.next_state) for r in dialog.hunt_replies(m, "intro", CLUES).orderBy("id").collect()] == [(0, 0, 1), (1, 1, 2), (2, 2, 1), (3, 0, 1)]


def test_message_verdicts(spark):
    high = "Patient #12345 passport AB1234567 Card: 4111 1111 1111 1111"
    rows = [(1, "a", 0, "hi"), (2, "a", 1, high), (3, "a", 2, "hi"), (4, "a", 3, high), (5, "a", 3, "hi"), (6, "b", 0, "hi"), (7, "a", 70, "hi"), (8, "a", 3700, None)]
    m = spark.createDataFrame([(i, s, at(t), c) for i, s, t, c in rows], "id long, sender string, ts timestamp, content string")
    blocked = spark.createDataFrame([("b", "spam")], "phone_number string, reason string")
    got = {r.id: (r.reason, r.recorded) for r in privacy.message_verdicts(m, blocked, [(60, 2), (3600, 10)]).collect()}
    assert got == {1: ("valid", True), 2: ("high_risk_content", False), 3: ("valid", True), 4: ("rate_limit_exceeded", False), 5: ("rate_limit_exceeded", False), 6: ("user_blocked", False), 7: ("valid", True), 8: ("valid", True)}


def test_word_vectors(spark):
    table = search.word_vectors(["bus", "train"], 4)
    df = search.embed(column(spark, ["A bus and a TRAIN", "nothing", None], "text"), "text", lambda: search.word_table_encoder(["train", "bus"], 4)).orderBy("id")
    got = [r.vector for r in df.collect()]
    assert got[0] == pytest.approx(((table["bus"] + table["train"]) / 2).tolist()) and got[1] == got[2] == [0.0] * 4


def test_consent_matches(spark):
    c = spark.createDataFrame([("x", "1", ["contact"], at(10), True, at(2)), ("y", "1", ["contact", "health"], at(99), True, at(1))], "consent_id string, phone_number string, data_categories array<string>, expires_at timestamp, is_active boolean, granted_at timestamp")
    q = spark.createDataFrame([(1, "1", at(5), ["contact"]), (2, "1", at(10), ["contact"]), (3, "1", at(5), ["other"])], "id long, phone_number string, ts timestamp, categories array<string>")
    assert {r.id: [x.consent_id for x in r.records] for r in privacy.consent_matches(q, c).collect()} == {1: ["y", "x"], 2: ["y"]}


def test_index_changes_by_one_aggregate(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("d", "2"), (None, "1"), ("n", None)], "id string, content_hash string")
    after = spark.createDataFrame([("b", "1"), ("c", "2"), ("d", "2"), ("d", "1"), ("e", "1"), (None, "2"), ("n", None)], "id string, content_hash string")
    got = corpus.index_changes(before, after)
    assert {(r.id, r.change) for r in got.collect()} == {("a", "removed"), ("c", "changed"), ("e", "added"), (None, "changed")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan


def test_strip_takes_the_white_space_of_the_pattern(spark):
    points = spark.range(0x3100).where("id not between 55296 and 57343").withColumn("c", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"))
    t = points.select(F.concat("c", F.lit("x y"), "c", "c").alias("t"))
    plain = F.regexp_replace("t", rf"^{text.SPACES}+|{text.SPACES}+$", "")
    assert t.where(~text.strip(F.col("t")).eqNullSafe(plain)).count() == 0 and t.where(F.length(text.strip(F.col("t"))) == 3).count() > 20
