"""Consent by sweeps against plain loops, a hot phone included."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from relayloom.operators import privacy

T0 = dt.datetime(2024, 1, 1)
RECORD = "consent_id string, phone_number string, data_categories array<string>, granted_at timestamp, expires_at timestamp, is_active boolean"
REQUEST = "id long, phone_number string, ts timestamp, categories array<string>"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def some(seed, n, hot):
    r = random.Random(seed)
    phone = lambda: "hot" if r.random() < hot else r.choice(["a", "b", None])
    kinds = lambda: r.choice([None, [], ["x"], ["x", "y"], ["y", "y", "z"], ["x", None]])
    records = [(f"c{i}", phone(), kinds(), at(g), r.choice([at(g + r.randrange(40)), None]), r.choice([True, True, False, None])) for i in range(n) for g in [r.randrange(60)]]
    requests = [(i, phone(), at(r.randrange(80)), kinds()) for i in range(n)]
    return records, requests


def covers(record, request):
    _, phone, kinds, _, until, active = record
    shared = {k for k in kinds or [] if k is not None} & set(request[3] or [])
    return bool(active and phone is not None and phone == request[1] and shared and until is not None and until > request[2])


@pytest.mark.parametrize("hot", [0.0, 0.8])
def test_sweeps_are_the_loops(spark, hot):
    records, requests = some(3, 150, hot)
    c, q = spark.createDataFrame(records, RECORD).repartition(3), spark.createDataFrame(requests, REQUEST).repartition(3)
    want = {x[0]: [r[0] for r in sorted((r for r in records if covers(r, x)), key=lambda r: (r[3], r[0]))] for x in requests}
    assert {r.id: [x.consent_id for x in r.records] for r in privacy.consent_matches(q, c).collect()} == {i: found for i, found in want.items() if found}
    assert {r.id for r in privacy.consented(q, c).collect()} == {i for i, found in want.items() if found}
    flags = {x[0]: any(covers(r, x) and r[3] <= x[2] for r in records) for x in requests}
    assert {r.id: r.consented for r in privacy.consent_flags(q, c).collect()} == flags and len(set(flags.values())) == 2


def test_no_request_meets_more_than_a_row(spark):
    records, requests = some(4, 60, 1.0)
    c, q = spark.createDataFrame(records, RECORD), spark.createDataFrame(requests, REQUEST)
    assert "Join" not in privacy.consent_matches(q, c)._jdf.queryExecution().executedPlan().toString()
    one = privacy.consented(q, c)._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("Join LeftSemi") == 1 and "map_from_entries" in one
    many = c.crossJoin(spark.range(40)).withColumn("consent_id", F.concat("consent_id", F.col("id").cast("string"))).drop("id")
    assert {r.id for r in privacy.consented(q, many).collect()} == {r.id for r in privacy.consented(q, c).collect()}


def test_nothing_to_sweep(spark):
    records, requests = some(5, 4, 0.5)
    c, q = spark.createDataFrame(records, RECORD), spark.createDataFrame(requests, REQUEST)
    assert privacy.consent_matches(q.where("false"), c).count() == 0 == privacy.consent_matches(q, c.where("false")).count()
    assert {r.consented for r in privacy.consent_flags(q, c.where("false")).collect()} == {False}
