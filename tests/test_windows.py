import random

from build import raw_events, rows
from pyspark.sql import functions as F

from threatloom.functions.scalars import attack_type
from threatloom.operators.enrich import enrich
from threatloom.operators.quota import flag_quota
from threatloom.operators.windows import first_sight, offender_count
from threatloom.schema import ATTACK_TYPES
from threatloom.sources.tables import default_rules

T = 1_779_285_600  # 2025-03-11T14:00:00Z


def arrivals(spark, instants):
    """(client, received_at, arrival) from (client, seconds) in log order."""
    data = [(client, int(round(s * 1000)), i) for i, (client, s) in enumerate(instants)]
    frame = spark.createDataFrame(data, "client string, ms long, arrival long")
    return frame.select("client", F.timestamp_millis("ms").alias("received_at"), "arrival").repartition(3)


def counts(spark, instants, **options):
    counted = offender_count(arrivals(spark, instants), F.col("client"), F.col("received_at"), **options)
    return [row[0] for row in rows(counted.orderBy("arrival"), "offenderEventCount")]


def brute(instants, span=600):
    order = sorted(range(len(instants)), key=lambda i: (instants[i][1], i))
    place = {i: p for p, i in enumerate(order)}
    return [
        sum(1 for j, (c, s) in enumerate(instants) if c == client and s >= at - span and place[j] <= place[i])
        for i, (client, at) in enumerate(instants)
    ]


def test_window_boundaries(spark):
    assert counts(spark, [("a", T)] * 4) == [1, 2, 3, 4]
    assert counts(spark, [("a", T - 660), ("a", T)]) == [1, 1]
    assert counts(spark, [("a", T - 600), ("a", T)]) == [1, 2]
    assert counts(spark, [("a", T - 600.001), ("a", T - 600), ("a", T)])[-1] == 2
    assert counts(spark, [("a", T)] * 6) == [1, 2, 3, 4, 5, 6]
    assert counts(spark, [("a", T - 60 * m) for m in (9, 7, 5, 3, 1)] + [("a", T)]) == [1, 2, 3, 4, 5, 6]
    assert counts(spark, [("a", T), ("b", T), ("a", T)]) == [1, 1, 2]


def test_hot_client_against_brute_force(spark):
    """Two thirds of the rows belong to one client, half of those to one instant."""
    random.seed(7)
    data = [("hot", 1000)] * 150 + [("hot", random.randrange(0, 4000)) for _ in range(150)]
    data += [(f"c{random.randrange(20)}", random.randrange(0, 4000) / 2) for _ in range(150)]
    random.shuffle(data)
    expected = brute(data)
    for options in ({}, {"stretch": 16}, {"stretch": 1, "cells": 1}, {"cells": 7}):
        assert counts(spark, data, **options) == expected


def test_collapsed_milliseconds(spark):
    data = [("a", T), ("a", T), ("a", T + 0.0004), ("a", T + 0.001), ("b", T), ("a", T + 600), ("a", T + 600.001)]
    assert counts(spark, data, collapse_millis=True, stretch=2) == [1, 1, 1, 2, 1, 3, 3]


def test_first_sight_keeps_the_earliest(spark):
    frame = spark.createDataFrame([("x", 5), ("x", 2), ("y", 3)] + [("hot", 10 + i) for i in range(50)], "id string, arrival long")
    assert sorted(rows(first_sight(frame, F.col("id")), "id", "arrival")) == [("hot", 10), ("x", 2), ("y", 3)]


def test_first_sight_trims_before_the_shuffle(spark):
    frame = spark.range(100).select((F.col("id") % 3).alias("key"), F.col("id").alias("arrival"))
    plan = first_sight(frame, F.col("key"))._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "Partial" in plan[exchange:] and "WindowGroupLimit" in plan[exchange:]


def test_enrichment_flow(spark):
    events = [{"eventId": f"k-{i}"} for i in range(1, 7)]
    enriched = enrich(raw_events(spark, events), default_rules(spark)).orderBy("arrival")
    assert [r[0] for r in rows(enriched, "threatScore")] == [75, 75, 75, 75, 75, 90]
    repeated = enrich(raw_events(spark, [{}, {}, {"eventId": "k-2"}]), default_rules(spark)).orderBy("arrival")
    got = rows(repeated, "rawEvent.eventId", "offenderEventCount", "attackType", "receivedAt")
    assert [row[:3] for row in got] == [("k-1", 1, "SQL/Command Injection"), ("k-2", 2, "SQL/Command Injection")]


def test_attack_types(spark):
    frame = spark.createDataFrame([(c,) for c in [*ATTACK_TYPES, "NOPE", None]], "c string")
    assert [r[0] for r in frame.select(attack_type(F.col("c"))).collect()] == [*ATTACK_TYPES.values(), None, None]


def quota(spark, requests, limit, seconds, **options):
    log = arrivals(spark, requests).withColumnRenamed("received_at", "ts")
    flagged = flag_quota(log, F.col("client"), F.col("ts"), limit, seconds, **options)
    return [row[0] for row in rows(flagged.orderBy("arrival"), "allowed")]


def test_quota_cases(spark):
    assert quota(spark, [("a", T)] * 5, 3, 60) == [True] * 3 + [False] * 2
    two = [("a", T)] * 3 + [("a", T + 60)] * 3
    assert quota(spark, two, 2, 60) == [True, True, False] * 2
    assert quota(spark, [("a", T), ("b", T), ("a", T), ("b", T)], 1, 60) == [True, True, False, False]
    steps = [("a", T + s) for s in (0, 1, 2, 3, 59, 60, 61, 62, 130)]
    assert quota(spark, steps, 2, 60) == [True, True, False, False, False, True, True, False, True]


def test_quota_against_brute_force(spark):
    random.seed(3)
    data = sorted([("hot", random.randrange(0, 3000)) for _ in range(300)] + [("b", random.randrange(0, 9000)) for _ in range(60)],
                  key=lambda r: r[1])
    expected, windows = [], {}
    for client, at in data:
        start, n = windows.get(client, (None, 0))
        start, n = (at, 1) if start is None or at >= start + 7 else (start, n + 1)
        windows[client] = (start, n)
        expected.append(n <= 2)
    assert quota(spark, data, 2, 7) == expected
    assert quota(spark, data, 2, 7, block=3, stretch=5) == expected
