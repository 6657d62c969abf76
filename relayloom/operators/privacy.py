"""Personal data screen, blocklists, consent, verdicts, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayloom.functions import vocabulary as V
from relayloom.operators.rate import admission
from relayloom.operators.shared import kept


def pii_scan(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds detected (array of type, category, sensitivity, count, first three matches), risk_score and risk_level.

    Each pattern runs once; counts and examples come from the same array.
    """
    df = df.withColumns({f"_m_{name}": F.regexp_extract_all(F.col(content), F.lit("(?U)" + pattern), F.lit(0)) for name, pattern, *_ in V.PII})
    item = lambda name, kind, level: F.when(F.size(f"_m_{name}") > 0, F.struct(F.lit(name).alias("type"), F.lit(kind).alias("category"), F.lit(level).alias("sensitivity"), F.size(f"_m_{name}").alias("count"), F.slice(f"_m_{name}", 1, 3).alias("matches")))
    score = sum((F.greatest(F.size(f"_m_{name}"), F.lit(0)) * V.RISK[level] for name, _, _, level in V.PII), F.lit(0))
    df = df.withColumns({"detected": F.array_compact(F.array(*[item(n, c, s) for n, _, c, s in V.PII])), "risk_score": score})
    return df.withColumn("risk_level", F.when(F.col("risk_score") > 20, "high").when(F.col("risk_score") > 10, "medium").otherwise("low")).drop(*[f"_m_{n}" for n, *_ in V.PII])


def redact(text: Column) -> Column:
    """Placeholders in pattern order, each pattern on what the ones before left."""
    for name, pattern, *_ in V.PII:
        text = F.regexp_replace(text, "(?U)" + pattern, f"[{name.upper()}_REDACTED]")
    return text


def pii_prevalence(scanned: DataFrame) -> DataFrame:
    """Matches, messages and risk for each pattern, each category and each sensitivity, and in total."""
    rows = scanned.select(F.explode("detected").alias("d")).select("d.type", "d.category", "d.sensitivity", "d.count")
    risk = F.col("count") * F.create_map(*[F.lit(x) for kv in V.RISK.items() for x in kv])[F.col("sensitivity")]
    grouped = rows.withColumn("risk", risk).groupingSets([[F.col("type"), F.col("category"), F.col("sensitivity")], [F.col("category")], [F.col("sensitivity")], []], F.col("type"), F.col("category"), F.col("sensitivity"))
    return grouped.agg(F.sum("count").alias("matches"), F.count("*").alias("messages"), F.sum("risk").alias("risk"))


def current_blocklist(events: DataFrame) -> DataFrame:
    """(phone_number, reason) whose latest block or unblock event is a block; ties go to the larger action name."""
    latest = Window.partitionBy("phone_number").orderBy(F.desc("ts"), F.desc("action"))
    return events.withColumn("_r", F.row_number().over(latest)).where("_r = 1 and action = 'block'").select("phone_number", "reason")


def split_blocked(messages: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rejected, passed) by the sender's presence in the blocklist; Spark broadcasts it while it is small."""
    keys = blocked.select(F.col("phone_number").alias("sender")).distinct()
    return messages.join(keys, "sender", "left_semi"), messages.join(keys, "sender", "left_anti")


def consented(requests: DataFrame, consents: DataFrame) -> DataFrame:
    """Requests (phone_number, ts, categories) with an active, unexpired record of an overlapping category.

    The latest expiry of each category decides, so a phone's records are one map by category before they meet a
    request: a request meets one row, however many records and requests its phone has.
    """
    each = consents.where("is_active").select(F.col("phone_number").alias("_phone"), F.explode("data_categories").alias("_category"), "expires_at").where("_category is not null")
    latest = each.groupBy("_phone", "_category").agg(F.max("expires_at").alias("until")).groupBy("_phone").agg(F.map_from_entries(F.collect_list(F.struct("_category", "until"))).alias("_until"))
    held = (F.col("phone_number") == F.col("_phone")) & F.exists("categories", lambda c: F.try_element_at("_until", c) > F.col("ts"))
    return requests.join(latest, held, "left_semi")


def _sweep(requests: DataFrame, consents: DataFrame, record_at: str) -> DataFrame:
    """Active records (at ``record_at``) and requests (at ts) in one table by phone and category: (phone, category, at, id, ts, record)."""
    record = F.struct("granted_at", "consent_id", "expires_at")
    c = consents.where("is_active").select(F.col("phone_number").alias("phone"), F.explode(F.array_distinct("data_categories")).alias("category"), F.col(record_at).alias("at"), record.alias("record"))
    r = requests.select(F.col("phone_number").alias("phone"), F.explode(F.array_distinct("categories")).alias("category"), F.col("ts").alias("at"), "id", "ts")
    return c.where("at is not null").unionByName(r, allowMissingColumns=True).where("phone is not null and category is not null")


def consent_matches(requests: DataFrame, consents: DataFrame) -> DataFrame:
    """(id, records): the active, unexpired records of an overlapping category that each request rests on, in order of grant.

    No join: records by expiry and requests by time are swept from late to early, so that what has been met when a
    request comes is what has not expired for it.  Beside the lists themselves the work is a sort.
    """
    late_first = Window.partitionBy("phone", "category").orderBy(F.desc("at"), F.col("id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = _sweep(requests, consents, "expires_at").withColumn("records", F.collect_list("record").over(late_first)).where("id is not null and size(records) > 0")
    return met.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("records")))).alias("records"))


def consent_flags(requests: DataFrame, consents: DataFrame) -> DataFrame:
    """(id, consented): whether a record that was granted by the time of the request covers it.

    Grants and requests are swept in order of time with the latest expiry so far.
    """
    in_order = Window.partitionBy("phone", "category").orderBy("at", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = _sweep(requests, consents, "granted_at").withColumn("until", F.max("record.expires_at").over(in_order)).where("id is not null")
    flags = swept.groupBy("id").agg(F.max(F.coalesce(F.col("until") > F.col("ts"), F.lit(False))).alias("consented"))
    return requests.select("id").distinct().join(flags, "id", "left").select("id", F.coalesce("consented", F.lit(False)).alias("consented"))


def grant(requests: DataFrame, expiry_days: int = 365) -> DataFrame:
    """Consent records of (phone_number, categories, status, ts): id, grant and expiry times, active flag."""
    key = F.concat_ws(":", "phone_number", F.array_join("categories", ","), F.unix_micros("ts").cast("string"))
    return requests.select(
        F.substring(F.md5(key), 1, 8).alias("consent_id"), "phone_number", F.col("categories").alias("data_categories"), F.col("status").alias("consent_status"),
        F.col("ts").alias("granted_at"), (F.col("ts") + F.make_interval(days=F.lit(expiry_days))).alias("expires_at"), (F.col("status") == "granted").alias("is_active"),
    )


def unexpired(consents: DataFrame, now: Column) -> DataFrame:
    """Records that expire after ``now``; unreadable dates go too."""
    return consents.where(F.try_to_timestamp(F.col("expires_at").cast("string")) > now)


def consent_records(consents: DataFrame, phone: str) -> DataFrame:
    return consents.where(F.col("phone_number") == phone).orderBy(F.desc("granted_at"), "consent_id")


def verdict(messages: DataFrame) -> DataFrame:
    """First failing check wins; wants blocked, within_limits and risk_level."""
    reason = F.when(F.col("blocked"), "user_blocked").when(~F.col("within_limits"), "rate_limit_exceeded").when(F.col("risk_level") == "high", "high_risk_content").otherwise("valid")
    return messages.withColumn("reason", reason).withColumn("valid", F.col("reason") == "valid")


def message_verdicts(messages: DataFrame, blocklist: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """(id, sender, ts, risk_level, blocked, within_limits, recorded, reason, valid) of (id, sender, ts, content).

    Blocked senders never reach the rate limit; a high-risk message is checked against it but not
    recorded, so only valid messages use up the budget.  Every text is screened once, in its own task; what is written
    and dealt by sender afterwards is its risk alone.
    """
    scanned = pii_scan(messages.select("id", "sender", "ts", "content")).select("id", "sender", "ts", "risk_level", (F.col("risk_level") != "high").alias("_recordable"))
    keys = blocklist.select(F.col("phone_number").alias("sender")).distinct().withColumn("_listed", F.lit(True))
    screened = kept(scanned.join(keys, "sender", "left").withColumn("blocked", F.coalesce("_listed", F.lit(False))).drop("_listed"), "screened")
    admitted = admission(screened.where("not blocked"), limits, recordable="_recordable")
    refused = screened.where("blocked").withColumns({"within_limits": F.lit(True), "recorded": F.lit(False)})
    return verdict(admitted.unionByName(refused)).drop("_recordable")


def audit_rows(decisions: DataFrame, event_type: str, details: list[str]) -> DataFrame:
    """Decisions as audit entries: timestamp, event_type and a map of the named columns."""
    pairs = [x for c in details for x in (F.lit(c), F.col(c).cast("string"))]
    return decisions.select(F.col("ts").alias("timestamp"), F.lit(event_type).alias("event_type"), F.create_map(*pairs).alias("details"))


def append_audit(entries: DataFrame, path: str) -> None:
    entries.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(path)


def newest_audit(entries: DataFrame, limit: int = 100, tie: Column | None = None) -> DataFrame:
    """The newest entries; equal times go by ``tie``, or by event type."""
    return entries.orderBy(F.desc("timestamp"), F.col("event_type") if tie is None else tie).limit(limit)


def privacy_stats(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("validations"), F.count_if(F.col("reason") == "user_blocked").alias("blocked"), F.count_if(F.col("reason") == "rate_limit_exceeded").alias("rate_limited"),
        F.count_if(F.col("reason") == "high_risk_content").alias("high_risk"), F.count_distinct("sender").alias("active_senders"),
    )
