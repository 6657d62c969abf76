"""Routing as of a message's time against a plain loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from relayloom.operators import fleet

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def plain(messages, beats, nodes, silence):
    since = dict(nodes)
    out = {}
    for i, t in messages:
        best = None
        for node, since_node in since.items():
            mine = [(b, load) for n, b, load in beats if n == node and b is not None and t is not None and b <= t]
            if mine:
                last, load = max(mine)
                if t - last < silence:
                    rank = (load is not None, load or 0, since_node, node)
                    best = min(best, rank) if best else rank
        out[i] = best[3] if best else None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_routing_is_the_loop(spark, seed):
    r = random.Random(seed)
    nodes = [(f"n{i}", r.randrange(2)) for i in range(5)]
    times = [r.randrange(600) for _ in range(20)] + [300] * 5  # many messages share an instant
    beats = list({(n, b): (n, b, r.choice([None, 0.5, 1.0, 2.0])) for n, b in [(r.choice(nodes)[0], r.choice(times)) for _ in range(80)]}.values()) + [("unknown", 3, 0.0)]
    messages = [(i, r.choice([*times, *[300] * 20, None, r.randrange(700)])) for i in range(300)]
    m = spark.createDataFrame([(i, at(t), "x") for i, t in messages], "id long, ts timestamp, node_id string").repartition(3)
    b = spark.createDataFrame([(n, at(t), load) for n, t, load in beats], "node_id string, ts timestamp, load double")
    got = fleet.route_to_nodes(m, b, spark.createDataFrame(nodes, "node_id string, registered_at long"), 60)
    assert {x.id: x.node_id for x in got.collect()} == plain(messages, beats, nodes, 60)
    assert len({x.part for x in got.selectExpr("spark_partition_id() as part").collect()}) > 1


def test_routing_plan(spark):
    m = spark.createDataFrame([(1, at(5))], "id long, ts timestamp")
    b = spark.createDataFrame([("a", at(1), 1.0)], "node_id string, ts timestamp, load double")
    n = spark.createDataFrame([("a", 0)], "node_id string, registered_at long")
    plan = fleet.route_to_nodes(m, b, n)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 5 and "NestedLoop" not in plan
    for empty in (m.where("false"), m):
        assert fleet.route_to_nodes(empty, b.where("false"), n).where("node_id is not null").count() == 0
