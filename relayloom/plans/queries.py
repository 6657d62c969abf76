"""One query an operator over the driver's tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relayloom.functions import vocabulary as V
from relayloom.operators import corpus, dialog, evaluate, fleet, privacy, rate, search, stats, text, vector_index
from relayloom.operators.shared import kept, shared_folder
from relayloom.plans.inputs import DOCS, EVENTS, MESSAGES, RECORDS, TURNS, WS, ascii_letters, ascii_letters_sql, docs, events, messages, records, table, turns
from relayloom.sources import messages as wire
from relayloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _in(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _count(words: list[str], t: str = "t") -> str:
    return "(" + " + ".join(f"CAST(contains({t}, '{w}') AS INT)" for w in words) + ")"


# Message understanding

def _stripped(column: str) -> str:
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


_LOW = f"(SELECT doc_id, lower({_stripped('text')}) AS t FROM {DOCS})"
_ROUTE = f"""CASE WHEN list_has_any(string_split_regex(t, '{WS}+'), [{_in([w for w in V.ROUTE_EMERGENCY if ' ' not in w])}]) OR {_count([w for w in V.ROUTE_EMERGENCY if ' ' in w])} > 0 THEN 'emergency'
 WHEN starts_with(t, '/') THEN 'command' WHEN t IN ({_in(V.GREETINGS)}) THEN 'template' ELSE 'query' END"""


@query(f"""SELECT doc_id, k AS message_type, CASE k WHEN 'command' THEN string_split_regex(t, '{WS}+')[1] WHEN 'template' THEN 'greeting' ELSE k END AS intent,
 CASE k WHEN 'emergency' THEN 'emergency' WHEN 'template' THEN 'low' ELSE 'normal' END AS priority, k = 'query' AS requires_rag FROM (SELECT *, {_ROUTE} AS k FROM {_LOW})""")
def p1_route_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.route_class(docs(spark, sf_dir), "text").select("doc_id", "message_type", "intent", "priority", "requires_rag")


_MARKS = "".join(c if c == "_" else "\\" + c for c in V.CLEAN_MARKS).replace("'", "''")
_CLEAN = f"(SELECT doc_id, lower(regexp_replace(regexp_replace({_stripped('text')}, '{WS}+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s{_MARKS}]', '', 'g')) AS t FROM {DOCS})"


@query(f"SELECT doc_id, md5(t) AS cleaned FROM {_CLEAN}")
def p2_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


@query(f"SELECT doc_id, CASE WHEN {_count(V.LANGUAGE_MARKS['es'])} > 0 THEN 'es' WHEN {_count(V.LANGUAGE_MARKS['fr'])} > 0 THEN 'fr' ELSE 'en' END AS language FROM {_CLEAN}")
def p3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.language(text.clean_text(F.col("text"))).alias("language"))


_INTENT = "CASE " + " ".join(f"WHEN {_count(w)} > 0 THEN '{n}'" for n, w, *_ in text.INTENTS) + " ELSE 'unknown' END"
_CONFIDENCE = "CASE " + " ".join(f"WHEN {_count(w)} > 0 THEN least({cap}::DOUBLE, {base}::DOUBLE + {_count(w)} * {step}::DOUBLE)" for _, w, base, step, cap in text.INTENTS) + " ELSE 0.1::DOUBLE END"
_CATEGORY = "CASE " + " ".join(f"WHEN {_count(w)} > 0 THEN '{n}'" for n, w in V.CATEGORIES.items()) + " ELSE 'general' END"


@query(f"SELECT doc_id, {_INTENT} AS intent, round({_CONFIDENCE}, 4) AS confidence FROM {_CLEAN}")
def p4_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text.with_intent(docs(spark, sf_dir).withColumn("clean_text", text.clean_text(F.col("text"))))
    return df.select("doc_id", "intent", F.round("intent_confidence", 4).alias("confidence"))


@query(f"SELECT doc_id, {_CATEGORY} AS category FROM {_CLEAN}")
def p5_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.category(text.clean_text(F.col("text"))).alias("category"))


def _sql_pattern(p: str) -> str:
    """A pattern with white space of all scripts; letters beyond ASCII are x by then, so word classes agree."""
    return p.replace(r"[\w\s]", r"[\w" + WS[1:]).replace(r"[-\s]", r"[-" + WS[1:]).replace(r"\s", WS).replace("'", "''")


_T2 = ascii_letters_sql("t")
_KNOWN = sorted({w for w in [*V.PARSE_EMERGENCY, *(w for c in V.CATEGORIES.values() for w in c)] if " " not in w and len(w) > 3})
_FOUND = {
    "us_phones": f"list_transform(regexp_extract_all(t, '{V.US_PHONE}'), lambda x: regexp_replace(x, '{V.US_PHONE}', '\\1-\\2-\\3'))",
    "intl_phones": f"regexp_extract_all(t, '{_sql_pattern(V.INTL_PHONE)}')",
    "emails": f"regexp_extract_all({_T2}, '{V.EMAIL}')",
    "urls": f"regexp_extract_all(t, '{_sql_pattern(V.URL)}')",
    "numbers": f"regexp_extract_all({_T2}, '{V.NUMBER}')",
    "dates": " || ".join(f"regexp_extract_all({_T2}, '{p}')" for p in V.DATES),
    "keywords": f"list_filter(string_split(t, ' '), lambda x: length(x) > 3 AND regexp_full_match(x, '\\p{{L}}+') AND (x IN ({_in(_KNOWN)}) OR contains('{' | '.join(V.PARSE_QUESTION)}', x)))",
}
_COUNTS = ", ".join(f"len({sql}) AS {n}" for n, sql in {"n_us": _FOUND["us_phones"], "n_intl": _FOUND["intl_phones"], "n_email": _FOUND["emails"], "n_keyword": _FOUND["keywords"]}.items())


@query(f"SELECT doc_id, {', '.join(f'array_to_string({sql}, chr(10)) AS {n}' for n, sql in _FOUND.items())} FROM {_CLEAN}")
def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text.entities(docs(spark, sf_dir).withColumn("clean_text", text.clean_text(F.col("text"))))
    df = df.withColumn("us_phones", F.transform("us_phones", lambda x: F.concat_ws("-", x["area"], x["exchange"], x["line"])))
    return df.select("doc_id", *[F.array_join(c, "\n").alias(c) for c in _FOUND])


_PARSED = f"""(SELECT doc_id, intent, category, category <> 'general' OR {_count(V.LOCAL_WORDS)} > 0 AS requires_rag, intent <> 'unknown' AS requires_llm,
 CASE WHEN intent = 'emergency' THEN 'emergency' WHEN n_us + n_intl > 0 THEN 'high' WHEN intent IN ('question', 'information') THEN 'normal' WHEN intent = 'command' THEN 'high' WHEN intent = 'greeting' THEN 'low' ELSE 'normal' END AS priority,
 round(least(1.0::DOUBLE, c + CASE WHEN n_us + n_intl > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n_email > 0 THEN 0.05::DOUBLE ELSE 0 END + least(0.2::DOUBLE, n_keyword * 0.05::DOUBLE)), 4) AS confidence
 FROM (SELECT doc_id, t, {_INTENT} AS intent, {_CONFIDENCE} AS c, {_CATEGORY} AS category, {_COUNTS} FROM {_CLEAN}))"""


@query(f"SELECT doc_id, requires_rag, requires_llm, priority FROM {_PARSED}")
def p7_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse(docs(spark, sf_dir).drop("category"), "text").select("doc_id", "requires_rag", "requires_llm", "priority")


@query(f"SELECT * FROM {_PARSED}")
def p8_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse(docs(spark, sf_dir).drop("category"), "text").select("doc_id", "intent", "category", "requires_rag", "requires_llm", "priority", "confidence")


def _listed(*cases: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test} THEN {say} END" for test, say in cases) + "], lambda x: x IS NOT NULL), '|')"


_SPAM = f"{_count(V.SPAM, 'lower(content)')} >= 2"


@query(f"""SELECT id, length(content) BETWEEN 1 AND 160 AS valid, {_listed(("length(content) > 160", f"format('{V.TOO_LONG.replace('%d', '{}')}', length(content))"), ("length(content) = 0", f"'{V.EMPTY}'"))} AS errors,
 {_listed((_SPAM, f"'{V.SPAM_WARNING}'"))} AS warnings, {_listed(("length(content) < 10", f"'{V.SHORT_HINT}'"), ("NOT regexp_matches(content, '[?!.]')", f"'{V.MARKS_HINT}'"))} AS suggestions FROM {TURNS}""")
def p9_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text.validate(turns(spark, sf_dir))
    return df.select("id", "valid", *[F.array_join(c, "|").alias(c) for c in ("errors", "warnings", "suggestions")])


@query(f"SELECT id, CASE WHEN length(content) > 160 THEN substring(content, 1, 157) || '...' ELSE content END AS reply, length(content) > 160 AS truncated FROM {TURNS}")
def p10_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("id", text.truncate(F.col("content")).alias("reply"), (F.length("content") > 160).alias("truncated"))


@query(f"""SELECT id, part_no, len(c) AS part_count, CASE WHEN length(content) <= 160 THEN content WHEN len(c) = 1 THEN bare ELSE bare || ' (' || part_no || '/' || len(c) || ')' END AS part
 FROM (SELECT *, CASE WHEN part_no = len(c) AND length(piece) <= 152 THEN piece ELSE regexp_replace(piece, '{WS}+$', '') END AS bare FROM (SELECT *, unnest(c) AS piece, generate_subscripts(c, 1) AS part_no
 FROM (SELECT id, content, CASE WHEN length(content) <= 160 THEN [content] ELSE regexp_extract_all(content, '(?s)(?:.{{1,152}}\\z|.{{0,151}} |.{{152}}){WS}*') END AS c FROM {TURNS})))""")
def p11_split_sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.split_sms(turns(spark, sf_dir), "content").select("id", "part_no", "part_count", "part")


_X = ascii_letters_sql("text")


def _pii(p: str) -> str:
    return f"len(regexp_extract_all(x, '{_sql_pattern(p)}'))"


_RISK = " + ".join(f"{_pii(p)} * {V.RISK[s]}" for _, p, _, s in V.PII)
_LEVEL = "CASE WHEN risk_score > 20 THEN 'high' WHEN risk_score > 10 THEN 'medium' ELSE 'low' END"
_DETECTED = _listed(*[(f"{_pii(p)} > 0", f"'{n}:{c}:{s}:' || {_pii(p)} || ':' || array_to_string(list_slice(regexp_extract_all(x, '{_sql_pattern(p)}'), 1, 3), ';')") for n, p, c, s in V.PII])
_SCAN = f"(SELECT *, {_LEVEL} AS risk_level FROM (SELECT doc_id, {_RISK} AS risk_score, md5({_DETECTED}) AS detected FROM (SELECT doc_id, {_X} AS x FROM {DOCS})))"


@query(f"SELECT doc_id, risk_score, risk_level, detected FROM {_SCAN}")
def p12_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("detected", lambda d: F.concat_ws(":", d["type"], d["category"], d["sensitivity"], d["count"].cast("string"), ascii_letters(F.array_join(d["matches"], ";"))))
    return privacy.pii_scan(docs(spark, sf_dir), "text").select("doc_id", F.col("risk_score").cast("long").alias("risk_score"), "risk_level", F.md5(F.array_join(said, "|")).alias("detected"))


_REDACTED = _X
for _name, _p, *_ in V.PII:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_sql_pattern(_p)}', '[{_name.upper()}_REDACTED]', 'g')"


@query(f"SELECT doc_id, md5({_REDACTED}) AS redacted FROM {DOCS}")
def p13_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(ascii_letters(privacy.redact(F.col("text")))).alias("redacted"))


@query(f"SELECT sender, count(*) + 2 AS n_messages, md5('system:Answer shortly.|' || string_agg(role || ':' || content, '|' ORDER BY us, id) || '|user:What is next?') AS prompt FROM {TURNS} GROUP BY sender")
def p14_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dialog.history_arrays(turns(spark, sf_dir)).withColumn("p", text.prompt("Answer shortly.", F.col("history"), F.lit("What is next?")))
    return df.select("sender", F.size("p").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("prompt"))


@query(f"SELECT id, title FROM {DOCS} WHERE category = 'src3'")
def p15_documents_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.col("category") == "src3").select("id", "title")


# Blocklists, consent, verdicts


def _block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("sender").alias("phone_number"), F.when(F.col("id") % 3 == 0, "block").otherwise("unblock").alias("action"), F.col("event_type").alias("reason"), "ts")


_BLOCKED = f"(SELECT sender AS phone_number, event_type AS reason FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'block' ELSE 'unblock' END AS action, row_number() OVER (PARTITION BY sender ORDER BY us DESC, CASE WHEN id % 3 = 0 THEN 'block' ELSE 'unblock' END DESC) AS r FROM {EVENTS}) WHERE r = 1 AND action = 'block')"


@query(f"SELECT phone_number FROM {_BLOCKED}")
def w9_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.current_blocklist(_block_events(spark, sf_dir)).select("phone_number")


@query(f"SELECT id, sender IN (SELECT phone_number FROM {_BLOCKED}) AS rejected FROM {TURNS}")
def j1_blocked_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected, passed = privacy.split_blocked(turns(spark, sf_dir), privacy.current_blocklist(_block_events(spark, sf_dir)))
    return rejected.select("id", F.lit(True).alias("rejected")).unionByName(passed.select("id", F.lit(False).alias("rejected")))


def _consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("sender").alias("phone_number"), F.array("event_type").alias("data_categories"), (F.col("ts") + F.make_interval(days=F.lit(3))).alias("expires_at"), (F.col("id") % 2 == 0).alias("is_active"), F.col("ts").alias("granted_at"), F.substring(F.md5(F.col("id").cast("string")), 1, 8).alias("consent_id"))


@query(f"SELECT r.id, string_agg(substring(md5(CAST(c.id AS VARCHAR)), 1, 8), ',' ORDER BY c.us, substring(md5(CAST(c.id AS VARCHAR)), 1, 8)) AS records FROM {EVENTS} r JOIN {EVENTS} c ON c.sender = r.sender AND c.id % 2 = 0 AND c.us + 259200000000 > r.us AND c.event_type = r.event_type GROUP BY r.id")
def j2_consented_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).select("id", F.col("sender").alias("phone_number"), "ts", F.array("event_type").alias("categories"))
    return privacy.consent_matches(requests, _consents(spark, sf_dir)).select("id", F.array_join(F.transform("records", lambda r: r["consent_id"]), ",").alias("records"))


@query(f"SELECT r.id, coalesce(bool_or(c.id IS NOT NULL), false) AS consented FROM {EVENTS} r LEFT JOIN {EVENTS} c ON c.sender = r.sender AND c.id % 2 = 0 AND c.us <= r.us AND c.us + 259200000000 > r.us AND c.event_type = r.event_type GROUP BY r.id")
def j2_consent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).select("id", F.col("sender").alias("phone_number"), "ts", F.array("event_type").alias("categories"))
    return privacy.consent_flags(requests, _consents(spark, sf_dir))


@query(f"SELECT sender AS phone_number, substring(md5(sender || ':' || event_type || ':' || us), 1, 8) AS consent_id, us // 1000000 + 31536000 AS expires, event_type = 'click' AS is_active FROM {EVENTS}")
def c8_grant_consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = events(spark, sf_dir).select("id", F.col("sender").alias("phone_number"), F.array("event_type").alias("categories"), F.when(F.col("event_type") == "click", "granted").otherwise("denied").alias("status"), "ts")
    made = privacy.grant(requests)
    return made.select("phone_number", "consent_id", F.floor(F.unix_micros("expires_at") / 1_000_000).alias("expires"), "is_active")


@query(f"SELECT substring(md5(CAST(id AS VARCHAR)), 1, 8) AS consent_id FROM {EVENTS} WHERE us + 259200000000 > 1705276800000000")
def c9_unexpired_consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.unexpired(_consents(spark, sf_dir), F.timestamp_seconds(F.lit(1_705_276_800))).select("consent_id")


@query(f"SELECT substring(md5(CAST(id AS VARCHAR)), 1, 8) AS consent_id FROM {EVENTS} WHERE sender = '7'")
def t5_consent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.consent_records(_consents(spark, sf_dir), "7").select("consent_id")


# Rate limits and windows

_HOURS = {"in_6h": 21_600, "in_day": 86_400}


@query("SELECT id, " + ", ".join(f"count(*) OVER (PARTITION BY sender ORDER BY us RANGE BETWEEN {s * 1_000_000 - 1} PRECEDING AND CURRENT ROW) - 1 AS {n}" for n, s in _HOURS.items()) + f" FROM {EVENTS}")
def w1_rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate.rate_counts(events(spark, sf_dir), _HOURS).select("id", *_HOURS)


_LIMITS = [(21_600, 2), (86_400, 3)]


def _admitted(source: str) -> str:
    """The admission fold over (id, sender, us, ok) as a recursion from each sender's row to the next."""
    within = " AND ".join(f"len(list_filter(f.kept, lambda t: m.us - t < {s * 1_000_000})) < {n}" for s, n in _LIMITS)
    return f"""(WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY us, id) AS rn FROM {source}),
 f AS (SELECT id, sender, rn, true AS within_limits, ok AS recorded, CASE WHEN ok THEN [us] ELSE []::BIGINT[] END AS kept FROM m WHERE rn = 1
 UNION ALL SELECT m.id, m.sender, m.rn, {within}, {within} AND m.ok, CASE WHEN {within} AND m.ok THEN list_append(f.kept, m.us) ELSE f.kept END FROM f JOIN m ON m.sender = f.sender AND m.rn = f.rn + 1) SELECT id, within_limits, recorded FROM f)"""


@query(f"SELECT * FROM {_admitted(f'(SELECT *, true AS ok FROM {EVENTS})')}")
def w2_rate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate.admission(events(spark, sf_dir), _LIMITS).select("id", "within_limits", "recorded")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.message_verdicts(messages(spark, sf_dir), privacy.current_blocklist(_block_events(spark, sf_dir)), _LIMITS)


_JUDGED = f"(SELECT *, {_LEVEL} AS risk_level FROM (SELECT id, sender, us, sender IN (SELECT phone_number FROM {_BLOCKED}) AS blocked, {_RISK} AS risk_score FROM (SELECT *, {ascii_letters_sql('content')} AS x FROM {MESSAGES})))"
_DECIDED = f"""(SELECT j.*, CASE WHEN blocked THEN 'user_blocked' WHEN NOT within_limits THEN 'rate_limit_exceeded' WHEN risk_level = 'high' THEN 'high_risk_content' ELSE 'valid' END AS reason
 FROM {_JUDGED} j LEFT JOIN {_admitted(f"(SELECT *, risk_level <> 'high' AS ok FROM {_JUDGED} WHERE NOT blocked)")} a ON a.id = j.id)"""


@query(f"SELECT id, risk_level, reason, reason = 'valid' AS valid FROM {_DECIDED}")
def f7_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("id", "risk_level", "reason", "valid")


@query(f"SELECT count(*) AS validations, count(*) FILTER (reason = 'user_blocked') AS blocked, count(*) FILTER (reason = 'rate_limit_exceeded') AS rate_limited, count(*) FILTER (reason = 'high_risk_content') AS high_risk, count(DISTINCT sender) AS active_senders FROM {_DECIDED}")
def a5_privacy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.privacy_stats(_decisions(spark, sf_dir))


@query(f"SELECT id, reason FROM (SELECT * FROM {_DECIDED} ORDER BY us DESC, id DESC LIMIT 100)")
def t4_newest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = privacy.audit_rows(_decisions(spark, sf_dir), "message_validated", ["id", "reason"])
    newest = privacy.newest_audit(rows, 100, F.desc(F.col("details")["id"].cast("long")))
    return newest.select(F.col("details")["id"].cast("long").alias("id"), F.col("details")["reason"].alias("reason"))


_S = f"(SELECT *, sum(fresh) OVER (PARTITION BY sender ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY sender ORDER BY us, id) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM {TURNS}))"


@query(f"SELECT id, session FROM {_S}")
def w4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog.sessions(turns(spark, sf_dir)).select("id", "session")


@query(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY sender, session ORDER BY us DESC, id DESC) AS r FROM {_S}) WHERE r <= 2")
def w3_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog.last_turns(dialog.sessions(turns(spark, sf_dir)), 2).select("id")


@query(f"""SELECT id, md5(coalesce(array_to_string(list(content) FILTER (NOT reset) OVER (PARTITION BY sender, session, part ORDER BY us, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '')) AS before
 FROM (SELECT *, sum(CAST(reset AS INT)) OVER (PARTITION BY sender ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, id % 5 = 2 AS reset FROM {_S}))""")
def w5_visible_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = dialog.sessions(turns(spark, sf_dir)).withColumns({"reset": F.col("id") % 5 == 2, "reply": F.lit("answer")})
    return dialog.visible_history(t, 3).select("id", F.md5(F.array_join(F.transform("history", lambda x: x["user"]), "|")).alias("before"))


@query(f"SELECT sender, count(*) AS n, md5(string_agg(role || ':' || content, '|' ORDER BY us, id)) AS history FROM {TURNS} GROUP BY sender")
def a12_history_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = dialog.history_arrays(turns(spark, sf_dir))
    return h.select("sender", F.size("history").cast("long").alias("n"), F.md5(F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("history"))


@query(f"""SELECT sender, block, count(*) AS n, md5(string_agg(role || ':' || content, '|' ORDER BY us, id)) AS turns
 FROM (SELECT *, (row_number() OVER (PARTITION BY sender ORDER BY us, id) - 1) // 3 AS block FROM {TURNS}) GROUP BY sender, block""")
def a12_history_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = dialog.history_blocks(turns(spark, sf_dir), 3)
    return b.select("sender", "block", "n", F.md5(F.array_join(F.transform("turns", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("turns"))


@query(f"""SELECT sender, count(*) AS n, md5(string_agg(role || ':' || content, '|' ORDER BY us, id)) AS history
 FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY us DESC, id DESC) AS r FROM {TURNS}) WHERE r <= 5 GROUP BY sender""")
def p14_newest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = dialog.newest_history(dialog.history_blocks(turns(spark, sf_dir), 3), 5, 3)
    return h.select("sender", F.size("history").cast("long").alias("n"), F.md5(F.array_join(F.transform("history", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("history"))


_INTRO = "Find the clues."
_CLUES = [{"id": i, "clue": f"Clue {i}", "answer_pattern": p, "success": f"Right, {i} solved.", "hint": f"Hint {i}"} for i, p in enumerate(("click|view", "purchase", "login|signup"), 1)]


def _hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("id") % 11 == 0, "HUNT").when(F.col("id") % 7 == 0, "HINT").when(F.col("id") % 5 == 0, F.concat(F.lit("CLUE "), (F.col("id") % 4).cast("string"))).otherwise(F.col("event_type"))
    return dialog.hunt_replies(events(spark, sf_dir).withColumn("content", said), _INTRO, _CLUES)


def _hunted() -> str:
    """The hunt's fold as a recursion over (sender, rn); ``clue`` is the number that a CLUE message asks for."""
    clues = "(VALUES " + ", ".join(f"({c['id']}, '{c['clue']}', '{c['answer_pattern']}', '{c['success']}', '{c['hint']}')" for c in _CLUES) + ") c(n, clue, pattern, success, hint)"
    said = f"(SELECT *, CASE WHEN id % 11 = 0 THEN 'hunt' WHEN id % 7 = 0 THEN 'hint' WHEN id % 5 = 0 THEN 'clue ' || id % 4 ELSE event_type END AS said FROM {EVENTS})"
    pick = lambda field, state: f"(SELECT {field} FROM {clues} WHERE n = {state})"
    reply = f"""CASE WHEN said = 'hunt' THEN '{_INTRO}' WHEN said = 'hint' THEN CASE WHEN before = 0 THEN '{V.HUNT["hint_early"].replace("'", "''")}' ELSE coalesce(hint, '{V.HUNT["no_hint"]}') END
 WHEN clue IS NOT NULL THEN CASE WHEN before = 0 THEN '{V.HUNT["clue_early"]}' WHEN clue > before THEN 'You haven''t unlocked Clue ' || clue || ' yet. Solve Clue ' || before || ' first.' ELSE coalesce(asked, '{V.HUNT["no_clue"]}') END
 WHEN before > 0 AND regexp_matches(said, pattern) THEN success END"""
    state = "CASE WHEN said = 'hunt' THEN 1 WHEN said = 'hint' OR clue IS NOT NULL THEN before WHEN before > 0 AND regexp_matches(said, pattern) THEN before + 1 ELSE before END"
    joined = f"LEFT JOIN {clues} ON c.n = before LEFT JOIN (SELECT n AS number, clue AS asked FROM {clues}) q ON q.number = x.clue"
    first = f"(SELECT m.*, 0 AS before, NULL::BIGINT AS since FROM m WHERE rn = 1) x"
    later = "(SELECT m.*, CASE WHEN f.touched IS NOT NULL AND m.us - f.touched > 86400000000 THEN 0 ELSE f.next_state END AS before, f.touched AS since FROM f JOIN m ON m.sender = f.sender AND m.rn = f.rn + 1) x"
    row = f"x.sender, x.id, x.rn, {reply} AS reply, before AS state, {state} AS next_state, CASE WHEN {reply} IS NOT NULL THEN x.us ELSE since END AS touched"
    row = row.replace(" clue ", " x.clue ")
    return f"""(WITH RECURSIVE m AS (SELECT sender, id, us, said, TRY_CAST(regexp_extract(said, '^clue (\\d+)', 1) AS INT) AS clue, row_number() OVER (PARTITION BY sender ORDER BY us, id) AS rn FROM {said}),
 f AS (SELECT {row} FROM {first} {joined} UNION ALL SELECT {row} FROM {later} {joined}) SELECT sender, id, reply, state, next_state FROM f WHERE reply IS NOT NULL)"""


@query(f"SELECT * FROM {_hunted()}")
def w6_treasure_hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hunt(spark, sf_dir).select("sender", "id", "reply", "state", "next_state")


@query(f"SELECT count(*) FILTER (reply = '{_INTRO}') AS started, count(*) FILTER (next_state > state AND state > 0) AS clues_solved, count(*) FILTER (next_state > state AND state = {len(_CLUES)}) AS completed FROM {_hunted()}")
def a13_hunt_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialog.hunt_funnel(_hunt(spark, sf_dir), _INTRO, len(_CLUES))


# Corpus

_WORDS = f"len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> ''))"
_KEYS = f"""(SELECT id, list(word ORDER BY n DESC, pos) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS r FROM (SELECT id, word, count(*) AS n, min(pos) AS pos
 FROM (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {DOCS})) WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN ({_in(V.STOP_WORDS)}) GROUP BY id, word)) WHERE r <= 10 GROUP BY id)"""


@query(f"SELECT id, array_to_string(keywords, ' ') AS keywords FROM {_KEYS}")
def a11_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.keywords(docs(spark, sf_dir)).select("id", F.array_join("keywords", " ").alias("keywords"))


@query(f"SELECT substring(md5(title || ':' || text), 1, 12) AS id, sha256(text) AS content_hash, coalesce(array_to_string(keywords, ' '), '') AS keywords, {_WORDS} AS word_count, length(text) AS char_count FROM {DOCS} d LEFT JOIN {_KEYS} k ON k.id = d.id")
def c2_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = corpus.enrich(docs(spark, sf_dir).drop("id"), F.lit("2024-01-01").cast("timestamp"))
    return full.select("id", "content_hash", F.array_join("keywords", " ").alias("keywords"), F.col("word_count").cast("long").alias("word_count"), F.col("char_count").cast("long").alias("char_count"))


@query(f"SELECT CASE WHEN doc_id % 2 = 0 THEN id ELSE substring(sha256(text), 1, 12) END AS id, doc_id FROM {DOCS}")
def c3_content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(corpus.content_id(F.when(F.col("doc_id") % 2 == 0, F.col("id")), F.col("text")).alias("id"), "doc_id")


@query(f"""SELECT parent_doc_id, chunk_index, md5(text) AS text, chunk_count FROM (SELECT id AS parent_doc_id, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS chunk_index, len(c) AS chunk_count FROM (SELECT id,
 CASE WHEN length(b) = 0 THEN [''] ELSE list_filter(list_transform(range(0, CASE WHEN length(b) <= 600 THEN 1 ELSE CAST(ceil((length(b) - 600) / 480.0) AS INT) + 1 END), lambda i: regexp_replace(substring(b, 480 * i + 1, 600), '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '') END AS c
 FROM (SELECT id, {_stripped('text')} AS b FROM {DOCS})))""")
def c4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    return corpus.chunks(d).select("parent_doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("text"), F.col("chunk_count").cast("long").alias("chunk_count"))


@query(f"""SELECT id, CASE WHEN p3 THEN 'new ' || title ELSE title END AS title, sha256(CASE WHEN p2 THEN 'new ' || text ELSE text END) AS content_hash,
 CASE WHEN doc_id % 21 = 0 THEN 'p=' || doc_id % 5 WHEN doc_id % 3 = 0 THEN 'lang=' || lang || ',p=' || doc_id % 5 ELSE 'lang=' || lang END AS metadata, CASE WHEN doc_id % 21 = 0 THEN 2025 ELSE 2024 END AS created, CASE WHEN doc_id % 3 = 0 THEN 2025 ELSE 2024 END AS updated
 FROM (SELECT *, doc_id % 3 = 0 AND doc_id % 2 = 1 AS p3, doc_id % 3 = 0 AND doc_id % 2 = 0 AS p2 FROM {DOCS})""")
def c5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda year: F.lit(f"{year}-06-01").cast("timestamp")
    d = docs(spark, sf_dir)
    base = d.where("not (doc_id % 3 = 0 and doc_id % 7 = 0)").withColumns({"created_at": at(2024), "updated_at": at(2024)})
    odd = F.col("doc_id") % 2 == 1
    patch = d.where("doc_id % 3 = 0").withColumns({"created_at": at(2025), "updated_at": at(2025), "metadata": F.create_map(F.lit("p"), (F.col("doc_id") % 5).cast("string"))})
    new = patch.withColumns({"seq": F.lit(2), "title": F.when(odd, F.concat(F.lit("new "), F.col("title"))).when(F.col("doc_id") % 7 == 0, F.col("title")), "text": F.when(~odd, F.concat(F.lit("new "), F.col("text"))).when(F.col("doc_id") % 7 == 0, F.col("text"))})
    old = patch.withColumns({"seq": F.lit(1), "title": F.lit("old")})
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return corpus.upsert(base, new.unionByName(old)).select("id", "title", "content_hash", entries.alias("metadata"), F.year("created_at").cast("long").alias("created"), F.year("updated_at").cast("long").alias("updated"))


@query(f"SELECT id FROM {DOCS} WHERE doc_id % 4 <> 0")
def c6_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return corpus.delete(d, d.where("doc_id % 4 = 0")).select("id")


@query(f"SELECT id FROM {EVENTS} WHERE id % 9 = 0 OR us >= 1705276800000000 - 864000000000")
def c7_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).withColumn("created_at", F.when(F.col("id") % 9 == 0, "unknown").otherwise(F.col("ts").cast("string")))
    return corpus.retained(d, F.timestamp_seconds(F.lit(1_705_276_800)), 10).select("id")


_NEW_IX = f"(SELECT id, sha256(text) AS h FROM {DOCS} WHERE doc_id % 4 <> 0)"
_OLD_IX = f"(SELECT id, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE sha256(text) END AS old FROM {DOCS} WHERE doc_id % 4 <> 1)"


def _indexes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    return d.where("doc_id % 4 <> 1").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("content_hash"))), d.where("doc_id % 4 <> 0")


@query(f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN h IS NULL THEN 'stale' WHEN old IS NULL THEN 'new' WHEN h <> old THEN 'changed' ELSE 'same' END AS action FROM {_NEW_IX} a FULL JOIN {_OLD_IX} b ON a.id = b.id")
def j4_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _indexes(spark, sf_dir)
    return corpus.sync_plan(after, before)


@query(f"SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN h IS NULL THEN 'removed' WHEN old IS NULL THEN 'added' WHEN h <> old THEN 'changed' END AS change FROM {_NEW_IX} a FULL JOIN {_OLD_IX} b ON a.id = b.id) WHERE change IS NOT NULL")
def c10_index_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_changes(*_indexes(spark, sf_dir))


@query(f"SELECT md5(t) AS key, min(CASE WHEN length(t) > 1024 THEN 1027 ELSE length(t) END) AS n FROM (SELECT text AS t FROM {DOCS}) WHERE md5(t) NOT IN (SELECT md5(text) FROM {DOCS} WHERE doc_id % 2 = 0) GROUP BY 1")
def c11_unseen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return corpus.unseen(d, d.where("doc_id % 2 = 0").select(F.md5("text").alias("key"))).select("key", F.length("text").cast("long").alias("n"))


@query(f"SELECT category, count(*) AS documents, sum({_WORDS}) AS words, round(avg({_WORDS}), 4) AS mean_words, count(DISTINCT category) AS categories FROM {DOCS} GROUP BY ROLLUP (category)")
def a3_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(docs(spark, sf_dir).withColumn("word_count", corpus.word_count(F.col("text"))))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS speaker_id, s_name AS name, coalesce(n, 0) AS n_sessions, md5(coalesce(sessions, '')) AS sessions FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, string_agg(o, ',' ORDER BY o) AS sessions FROM (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS o, l_suppkey FROM lineitem) GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def j8_speaker_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("speakers"))
    speakers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return corpus.speaker_sessions(sessions, speakers).select("speaker_id", "name", "n_sessions", F.md5(F.coalesce(F.array_join("sessions", ","), F.lit(""))).alias("sessions"))


def _entries(df: DataFrame) -> DataFrame:
    """Corpus documents with their metadata as text."""
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return df.select("doc_id", "text", entries.alias("metadata"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'Session: Order ' || o_orderkey || '. Track: ' || o_orderpriority || '. Day 1, 9:00, Room ' || o_orderstatus || '. Type: talk. Of ' || o_custkey AS text, 'category=sessions,track=' || o_orderpriority || ',type=talk' AS metadata FROM orders")
def c1_flatten_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    o = table(spark, sf_dir, "orders")
    return _entries(corpus.session_documents(o.select(key.alias("id"), F.concat(F.lit("Order "), key).alias("title"), F.col("o_orderpriority").alias("track"), F.lit(1).alias("day"), F.lit("9:00").alias("time"), F.col("o_orderstatus").alias("room"), F.lit("talk").alias("type"), F.concat(F.lit("Of "), F.col("o_custkey").cast("string")).alias("description"))))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, 'Speaker: ' || s_name || ', Seller at ' || n_name || '. Number ' || s_suppkey || ' Speaking at ' || coalesce(n, 0) || ' session(s).' AS text, 'category=speakers,company=' || n_name AS metadata FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def c1_flatten_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_orderkey").alias("sessions"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(sessions, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    key = F.col("s_suppkey").cast("string")
    return _entries(corpus.speaker_documents(s.select(key.alias("id"), F.col("s_name").alias("name"), F.lit("Seller").alias("title"), F.col("n_name").alias("company"), F.concat(F.lit("Number "), key).alias("bio"), "sessions")))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(f"""SELECT 'schedule_overview' AS doc_id, c_name || ' runs always at ' || c_mktsegment || '.' AS text, 'category=schedule,priority=high' AS metadata FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)
 UNION ALL SELECT 'sched_' || {_DAY} || '_0900_1000', {_DAY} || ' \u2014 09:00-10:00: Order ' || o_orderkey || '. Location: ' || o_orderstatus || '.' || CASE WHEN o_orderkey % 2 = 0 THEN ' Presented by ' || o_orderpriority || '.' ELSE '' END, 'category=schedule,day=' || {_DAY} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def c1_flatten_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    block = F.struct(F.lit("09:00-10:00").alias("time"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("location"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("speaker"))
    days = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(day.alias("date"), day.alias("label"), F.array(block).alias("blocks"))).alias("days"))
    c = table(spark, sf_dir, "customer").join(days, F.col("o_custkey") == F.col("c_custkey"))
    return _entries(corpus.schedule_documents(c.select(F.col("c_name").alias("conference"), F.lit("always").alias("dates"), F.col("c_mktsegment").alias("location"), "days")))


@query(f"SELECT id AS doc_id, md5(text) AS text, 'category=' || CASE WHEN doc_id % 2 = 0 THEN category ELSE 'architecture' END AS metadata FROM {DOCS}")
def c1_flatten_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumn("category", F.when(F.col("doc_id") % 2 == 0, F.col("category")))
    return _entries(corpus.architecture_documents(d)).withColumn("text", F.md5("text"))


# Search

_Q = f"(SELECT item_id AS query_id, lower(coalesce(text, '')) AS q, CASE WHEN item_id % 2 = 1 THEN 'src' || item_id % 20 END AS wanted FROM benchmark)"
_HITS = f"""(SELECT query_id, doc_id, (CASE WHEN contains(lower(title), q) THEN 10 ELSE 0 END + 5 * len(list_filter(keywords, lambda x: contains(q, x) OR contains(x, q))) + 2 * ((length(lower(text)) - length(replace(lower(text), q, ''))) // length(q)) + len(list_filter(words, lambda w: contains(lower(text), w)))) AS score
 FROM (SELECT d.*, coalesce(k.keywords, []) AS keywords FROM {DOCS} d LEFT JOIN {_KEYS} k ON d.id = k.id) JOIN (SELECT *, list_filter(string_split_regex(q, '{WS}+'), lambda w: w <> '') AS words FROM {_Q}) ON wanted IS NULL OR wanted = category WHERE len(words) > 0)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("item_id") % 2 == 1, F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), wanted.alias("category"))


@query(f"SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM {_HITS} WHERE score > 0) WHERE r <= 5")
def j6_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_search(_questions(spark, sf_dir), docs(spark, sf_dir), 5).select("query_id", "doc_id", F.col("score").cast("long").alias("score"))


@query("SELECT query_id, doc_id, round(distance, 6) AS distance FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, d AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY d, v.vec_id) AS r FROM (SELECT q.vec_id AS qid, v.vec_id AS vid, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))) AS d FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) x JOIN embeddings q ON q.vec_id = x.qid JOIN embeddings v ON v.vec_id = x.vid) WHERE r <= 5")
def j7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return search.vector_search(q, v, 5).select("query_id", "doc_id", F.round("distance", 6).alias("distance"))


@query()
def j7_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    path = shared_folder(spark, "vector-index")
    vector_index.build_index(v, path)
    q = v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return vector_index.index_search(q, path, 10).select("query_id", "doc_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT sender, id FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY value DESC, id) AS r FROM {EVENTS}) WHERE r <= 3")
def t1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(events(spark, sf_dir), 3, "sender", "value", "id").select("sender", "id")


def _side(where: str, n: int, side: int, score: str) -> str:
    return f"SELECT sender AS query_id, event_type AS doc, {score} AS score, id, {side} AS side, r FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY value DESC, sha256(event_type) || '{{\"id\":\"' || id || '\"}}') AS r FROM {EVENTS} WHERE {where}) WHERE r <= {n}"


@query(f"""SELECT query_id, doc, round(score, 6) AS score, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM (SELECT query_id, sha256(doc) AS key, min(doc) AS doc, max(score) AS score, arg_min(id, struct_pack(a := side, b := r)) AS id FROM
 ({_side("id % 2 = 0", 2, 0, "value / 200")} UNION ALL {_side("id % 2 = 1", 2, 1, "least(value / 15, 1)")}) GROUP BY query_id, sha256(doc)) WHERE score >= 0.5) WHERE r <= 2""")
def t2_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("id", F.col("sender").alias("query_id"), F.col("event_type").alias("document"), F.col("value").alias("score"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("metadata"))
    got = search.combine(e.where("id % 2 = 0").withColumn("score", F.col("score") / 200), e.where("id % 2 = 1"), 2)
    return got.select("query_id", F.col("document").alias("doc"), F.round("score", 6).alias("score"), F.col("metadata")["id"].cast("long").alias("id"))


@query(f"""WITH k AS (SELECT query_id, doc_id, score FROM {_HITS} WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3),
 d AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, 1 / (1 + list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])))) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings v),
 v AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3),
 s AS (SELECT x.*, text FROM (SELECT query_id, doc_id, score FROM v UNION ALL SELECT query_id, doc_id, least(score / 15, 1) FROM k) x JOIN {DOCS} USING (doc_id)),
 g AS (SELECT query_id, sha256(text) AS key, min(text) AS text, max(score) AS score FROM s GROUP BY ALL),
 t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM g WHERE score >= 0.5 QUALIFY r <= 3),
 b AS (SELECT query_id, max(score) FILTER (r = 1) AS best, max(text) FILTER (r = 1) AS top, string_agg(text, chr(10) || chr(10) ORDER BY r) AS context, count(*) AS n FROM t GROUP BY query_id)
SELECT query_id, n, CASE WHEN best >= 0.7 AND length(top) <= 160 THEN 'direct' ELSE 'model' END AS route, md5(CASE WHEN best >= 0.7 AND length(top) <= 160 THEN top END) AS answer, md5(context) AS context FROM b""")
def flow_hybrid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = _questions(spark, sf_dir).join(v.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    hits = kept(search.hybrid_search(asked, docs(spark, sf_dir), v, 3), "hits")
    routed = search.answer_route(hits).join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    return routed.select("query_id", "n", "route", F.md5("answer").alias("answer"), F.md5("context").alias("context"))


@query("SELECT a.vec_id AS vec_id, b.vec_id AS other_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0")
def f2_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return search.cosines(q, v, 6).select(F.col("doc_id").alias("vec_id"), F.col("query_id").alias("other_id"), "similarity")


@query()
def f1_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [w for c in V.CATEGORIES.values() for w in c] + V.PARSE_QUESTION
    return search.embed(docs(spark, sf_dir), "text", lambda: search.word_table_encoder(known, 32)).select("doc_id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"))


@query(f"""SELECT sender AS query_id, CASE WHEN best >= 60 AND length(top) <= 160 THEN 'direct' ELSE 'model' END AS route FROM (SELECT sender, max(value) AS best, arg_max(event_type, struct_pack(a := value, b := -r)) AS top FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY value DESC, id) AS r FROM {EVENTS}) WHERE r <= 3 GROUP BY sender)""")
def f5_answer_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.top_k(events(spark, sf_dir), 3, "sender", "value", "id").select(F.col("sender").alias("query_id"), F.col("event_type").alias("document"), F.col("value").alias("score"), "rank")
    return search.answer_route(hits, 60).select("query_id", "route")


@query(f"""SELECT doc_id, md5(CASE k WHEN 'template' THEN '{V.REPLY_GREETING}' WHEN 'emergency' THEN '{V.REPLY_EMERGENCY}' WHEN 'command' THEN '{V.REPLY_UNKNOWN}' END) AS reply FROM (SELECT *, {_ROUTE} AS k FROM {_LOW})""")
def f6_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.reply(text.route_class(docs(spark, sf_dir), "text")).select("doc_id", F.md5("reply").alias("reply"))


# Evaluation


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), rf"{text.SPACES}+"), lambda w: w != "")
    truth = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")).alias("category"), F.slice(words, 1, 3).alias("expected_keywords"), F.slice(words, 4, 2).alias("expected_entities"), F.slice(words, 6, 1).alias("forbidden_keywords"), F.lit(15000.0).alias("max_acceptable_latency_ms"))
    d = docs(spark, sf_dir)
    responses = d.select("doc_id", (F.col("doc_id") % 50).cast("string").alias("query_id"), F.col("text").alias("response"), (F.length("text") * 10.0).alias("latency_ms"))
    return evaluate.with_truth(evaluate.with_repetition(responses), truth)


_TRUTH = "(SELECT CAST(item_id AS VARCHAR) AS query_id, 'c' || item_id % 4 AS category, list_slice(w, 1, 3) AS kw, list_slice(w, 4, 5) AS en, list_slice(w, 6, 6) AS fb FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '" + WS + "+'), lambda x: x <> '') AS w FROM benchmark))"
_REP = f"""(SELECT d.doc_id, round(1 - coalesce(p, 0), 4) AS repetition FROM {DOCS} d LEFT JOIN (SELECT doc_id, least(1, sum(p) / 2) AS p FROM (SELECT doc_id, n, sum(CASE WHEN c > 2 THEN c - 1 ELSE 0 END) / sum(c) AS p FROM (SELECT doc_id, n, g, count(*) AS c FROM
 (SELECT doc_id, 2 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {DOCS}) WHERE len(w) >= 4
 UNION ALL SELECT doc_id, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {DOCS}) WHERE len(w) >= 4)
 GROUP BY ALL) GROUP BY ALL) GROUP BY doc_id) x ON x.doc_id = d.doc_id)"""
_SCORES = f"""(SELECT *, 0.25 * kws + 0.25 * ens + 0.15 * fbs + 0.1 * ls + 0.1 * lat + 0.15 * repetition AS composite FROM (SELECT d.doc_id, t.query_id, t.category, length(text) * 10.0 AS latency_ms, repetition,
 CASE WHEN len(kw) = 0 THEN 1 ELSE len(list_filter(kw, lambda k: contains(lower(text), k))) / len(kw) END AS kws, CASE WHEN len(en) = 0 THEN 1 ELSE len(list_filter(en, lambda k: contains(lower(text), k))) / len(en) END AS ens,
 CASE WHEN len(list_filter(fb, lambda k: contains(lower(text), k))) = 0 THEN 1 ELSE 0 END AS fbs, CASE WHEN length(text) <= 160 THEN 1 ELSE 0 END AS ls,
 CASE WHEN length(text) * 10 <= 15000 THEN 1 WHEN length(text) * 10 <= 30000 THEN 1 - (length(text) * 10 - 15000) / 15000 ELSE 0 END AS lat FROM {DOCS} d JOIN {_TRUTH} t ON t.query_id = CAST(d.doc_id % 50 AS VARCHAR) JOIN {_REP} r ON r.doc_id = d.doc_id))"""


@query(f"SELECT doc_id, repetition FROM {_REP}")
def f4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.repetition(docs(spark, sf_dir), "doc_id", "text")


@query(f"SELECT doc_id FROM {DOCS} WHERE doc_id % 50 NOT IN (SELECT item_id FROM benchmark)")
def j3_unknown_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[1].select("doc_id")


@query(f"SELECT doc_id, round(kws, 4) AS keyword_score, round(ens, 4) AS entity_score, fbs::DOUBLE AS forbidden_score, round(lat, 4)::DOUBLE AS latency_score, round(composite, 3) AS composite FROM {_SCORES}")
def f3_response_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.score(_evaluated(spark, sf_dir)[0])
    return s.select("doc_id", F.round("keyword_score", 4).alias("keyword_score"), F.round("entity_score", 4).alias("entity_score"), "forbidden_score", F.round("latency_score", 4).alias("latency_score"), F.round("composite", 3).alias("composite"))


@query(f"SELECT category, count(*) AS total, count(*) FILTER (composite >= 0.5) AS passed, round(avg(kws), 3) AS mean_keyword, round(avg(latency_ms), 3) AS mean_latency_ms FROM {_SCORES} GROUP BY ROLLUP (category)")
def a9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.report(evaluate.score(_evaluated(spark, sf_dir)[0]))
    return r.select("category", "total", "passed", F.round("mean_keyword", 3).alias("mean_keyword"), F.round("mean_latency_ms", 3).alias("mean_latency_ms"))


@query(f"SELECT category, 'pass_rate' AS metric, count(*) FILTER (composite >= 0.5) / count(*) >= 0.6 AS ok FROM {_SCORES} GROUP BY ROLLUP (category)")
def a10_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluate.report(evaluate.score(_evaluated(spark, sf_dir)[0]))
    limits = spark.createDataFrame([(c, "pass_rate", 0.6) for c in (None, "c0", "c1", "c2", "c3")], "category string, metric string, least double")
    return evaluate.gates(r, limits).select("category", "metric", "ok")


# Statistics and fleet


@query(f"""SELECT count(*) AS received, count(*) FILTER (k = 'emergency') AS emergency_messages, count(*) FILTER (k = 'query') AS query_messages, count(*) FILTER (k = 'query' AND length(t) <= 400) AS direct,
 round(count(*) FILTER (k = 'query' AND length(t) <= 400) / count(*) FILTER (k = 'query'), 4) AS direct_share FROM (SELECT *, {_ROUTE} AS k FROM {_LOW})""")
def a1_router_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = text.route_class(docs(spark, sf_dir), "text")
    short = F.length(text.strip(F.col("text"))) <= 400
    r = r.withColumns({"route": F.when(F.col("message_type") == "query", F.when(short, "direct").otherwise("model")), "responded": F.lit(True), "failed": F.lit(False)})
    return stats.router_counters(r).select("received", "emergency_messages", "query_messages", "direct", "direct_share")


@query(f"SELECT count(*) AS total, count(*) FILTER (id % 10 <> 0) AS ok, round(avg(value) FILTER (id % 10 <> 0), 3) AS mean_latency_s, sum(id % 100) FILTER (id % 10 <> 0) AS tokens, CASE WHEN avg(value) FILTER (id % 10 <> 0) < 5 THEN 'good' WHEN avg(value) FILTER (id % 10 <> 0) < 15 THEN 'warn' ELSE 'bad' END AS band FROM {EVENTS}")
def a2_model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = events(spark, sf_dir).select((F.col("id") % 10 != 0).alias("ok"), F.col("value").alias("latency_s"), (F.col("id") % 100).alias("tokens"))
    return stats.model_stats(calls).select("total", "ok", F.round("mean_latency_s", 3).alias("mean_latency_s"), "tokens", "band")


@query(f"SELECT event_type AS service, count(*) AS total, count(*) FILTER (value > 20) AS ok, max(us) AS last_us FROM {EVENTS} GROUP BY 1")
def a14_service_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.service_counters(events(spark, sf_dir).select(F.col("event_type").alias("service"), (F.col("value") > 20).alias("ok"), "ts"))
    return s.select("service", "total", "ok", F.unix_micros("last_ts").alias("last_us"))


_PII_LONG = " UNION ALL ".join(f"SELECT '{n}' AS type, '{c}' AS category, '{s}' AS sensitivity, {_pii(p)} AS n, {V.RISK[s]} AS w FROM (SELECT {_X} AS x FROM {DOCS})" for n, p, c, s in V.PII)


@query(f"SELECT type, category, sensitivity, sum(n) AS matches, count(*) AS messages, sum(n * w) AS risk FROM ({_PII_LONG}) WHERE n > 0 GROUP BY GROUPING SETS ((type, category, sensitivity), (category), (sensitivity), ())")
def a4_pii_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pii_prevalence(privacy.pii_scan(docs(spark, sf_dir), "text"))


@query(f"SELECT event_type, round(quantile_cont(value, 0.5) + 1e-9, 3) AS p50_ms, round(quantile_cont(value, 0.95) + 1e-9, 3) AS p95_ms, round(quantile_cont(value, 0.99) + 1e-9, 3) AS p99_ms, count(*) AS completed FROM {EVENTS} WHERE id % 10 <> 0 GROUP BY 1")
def a7_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ok", F.col("id") % 10 != 0)
    p = stats.latency_percentiles(e, "event_type", "value")
    return p.select("event_type", *[F.round(F.col(c) + 1e-9, 3).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")], "completed")


@query("SELECT l_returnflag, arg_max(stage, mean) AS stage, round(max(mean), 3) AS mean_ms FROM (SELECT l_returnflag, 'l_quantity' AS stage, avg(l_quantity)::DOUBLE AS mean FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_discount', avg(l_discount)::DOUBLE FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_tax', avg(l_tax)::DOUBLE FROM lineitem GROUP BY 1) GROUP BY 1")
def a8_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = ["l_quantity", "l_discount", "l_tax"]
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *[F.col(c).cast("double").alias(c) for c in stages])
    return stats.bottleneck(li, stages, "l_returnflag").select("l_returnflag", "stage", F.round("mean_ms", 3).alias("mean_ms"))


@query(f"SELECT burst_size, round(p + 1e-9, 3) AS p95_ms, coalesce(p >= 0.8 * lag(p) OVER (ORDER BY burst_size), true) AS ok FROM (SELECT id % 8 AS burst_size, quantile_cont(value, 0.95) AS p FROM {EVENTS} GROUP BY 1)")
def w7_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select((F.col("id") % 8).alias("burst_size"), "value", F.lit(True).alias("ok"))
    d = stats.degradation(stats.latency_percentiles(e, "burst_size", "value"))
    return d.select("burst_size", F.round(F.col("p95_ms") + 1e-9, 3).alias("p95_ms"), "ok")


@query(f"SELECT id, sender, us, md5(content) AS content, NULL AS event_type FROM {TURNS} UNION ALL SELECT id, sender, us, NULL, event_type FROM {EVENTS}")
def t3_message_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.message_history(turns(spark, sf_dir), events(spark, sf_dir)).select("id", "sender", F.unix_micros("ts").alias("us"), F.md5("content").alias("content"), "event_type")


# Sources and streams, on tables


@query(f"SELECT conv_id || '-' || turn AS id, CASE WHEN ok THEN CAST(conv_id AS VARCHAR) ELSE 'unknown' END AS sender, 'system' AS receiver, md5(CASE WHEN ok THEN coalesce(text, '') ELSE '' END) AS content, CASE WHEN ok AND turn % 3 = 0 THEN 'high' ELSE 'normal' END AS priority, CASE WHEN ok THEN role END AS role, ok FROM {RECORDS}")
def s1_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire.decode(records(spark, sf_dir)).select("id", "sender", "receiver", F.md5("content").alias("content"), "priority", F.col("metadata")["role"].alias("role"), "ok")


@query(f"SELECT CAST(conv_id AS VARCHAR) AS key, CAST(conv_id AS VARCHAR) AS sender, md5(coalesce(text, '')) AS content, CASE WHEN turn % 3 = 0 THEN 'high' ELSE 'normal' END AS priority, role FROM {RECORDS} WHERE ok")
def s2_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = wire.encode(wire.dead_letters(wire.decode(records(spark, sf_dir)), F.lit(None).cast("timestamp"))[0])
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return sent.select("key", field("sender").alias("sender"), F.md5(field("content")).alias("content"), field("priority").alias("priority"), F.get_json_object(field("metadata"), "$.role").alias("role"))


@query("SELECT conv_id || '-' || turn AS id FROM conversations")
def r2_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.deduplicated(wire.decode(records(spark, sf_dir))).select("id")


@query(f"SELECT conv_id || '-' || turn AS id, '{{broken' AS raw, 1704067200 AS failed_s FROM {RECORDS} WHERE NOT ok")
def r3_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = wire.dead_letters(wire.decode(records(spark, sf_dir)), F.timestamp_seconds(F.lit(1_704_067_200)))[1]
    return dead.select("id", "raw", F.unix_seconds("failed_at").alias("failed_s"))


@query(f"SELECT us - us % 3600000000 AS start_us, event_type, count(*) AS n FROM {EVENTS} GROUP BY ALL")
def r4_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.traffic(events(spark, sf_dir), kind="event_type", length="1 hour").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(f"SELECT sender, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS turns FROM {_S} GROUP BY sender, session")
def r5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.conversation_sessions(turns(spark, sf_dir)).select("sender", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "turns")


_BEATS = f"(SELECT 'n' || CAST(sender AS INT) % 12 AS node_id, us, id, value FROM {EVENTS})"


def _fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir).withColumn("node_id", F.concat(F.lit("n"), (F.col("sender").cast("int") % 12).cast("string")))
    reg = e.where("cast(sender as int) % 12 < 10").groupBy("node_id").agg(F.min("ts").alias("ts")).withColumn("api_url", F.col("node_id"))
    beats = e.groupBy("node_id", "ts").agg(F.max("id").alias("messages_received"), F.max("value").alias("avg_latency_ms"), F.min("id").alias("rag_direct"))
    return reg, beats


_STATE = f"""(SELECT node_id, last_us, messages_received, avg_latency_ms, rag_direct, 1706659200000000 - last_us < 3600000000 AS online FROM (SELECT node_id, max(us) AS last_us, arg_max(m, us) AS messages_received, arg_max(v, us) AS avg_latency_ms, arg_max(d, us) AS rag_direct
 FROM (SELECT node_id, us, max(id) AS m, max(value) AS v, min(id) AS d FROM {_BEATS} GROUP BY 1, 2) GROUP BY 1) WHERE CAST(substring(node_id, 2) AS INT) < 10)"""


@query(f"SELECT node_id, last_us, CASE WHEN online THEN 'online' ELSE 'offline' END AS status, messages_received FROM {_STATE}")
def w8_fleet_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = fleet.fleet_state(*_fleet(spark, sf_dir), F.timestamp_seconds(F.lit(1_706_659_200)), 3600)
    return nodes.select("node_id", F.unix_micros("last_seen").alias("last_us"), "status", "messages_received")


@query(f"SELECT count(*) AS nodes, count(*) FILTER (online) AS online, sum(messages_received) AS messages, round(avg(avg_latency_ms), 3) AS mean_latency_ms, sum(rag_direct) AS direct FROM {_STATE}")
def a6_fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = fleet.fleet_state(*_fleet(spark, sf_dir), F.timestamp_seconds(F.lit(1_706_659_200)), 3600)
    return fleet.fleet_summary(nodes).withColumn("mean_latency_ms", F.round("mean_latency_ms", 3))


@query(f"""SELECT m.id, arg_min(b.node_id, struct_pack(a := b.load, b := b.node_id)) AS node_id FROM {EVENTS} m LEFT JOIN (SELECT node_id, us, max(value) AS load, lead(us) OVER (PARTITION BY node_id ORDER BY us) AS n FROM {_BEATS} GROUP BY 1, 2) b
 ON b.us <= m.us AND m.us < least(coalesce(b.n, 4611686018427387904), b.us + 21600000000) GROUP BY m.id""")
def j5_least_loaded_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    beats = e.withColumn("node_id", F.concat(F.lit("n"), (F.col("sender").cast("int") % 12).cast("string"))).groupBy("node_id", "ts").agg(F.max("value").alias("load"))
    nodes = beats.select("node_id").distinct().withColumn("registered_at", F.lit(0))
    return fleet.route_to_nodes(e, beats, nodes, 21_600).select("id", "node_id")
