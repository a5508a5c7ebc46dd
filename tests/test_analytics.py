import re

import pytest
from build import rows, set_a, stored
from pyspark.sql import functions as F

from threatloom.functions.scalars import client_key, round1
from threatloom.operators import analytics as an
from threatloom.operators.alerts import evaluate_alerts, validate_alert_rules
from threatloom.operators.store import write_events
from threatloom.operators.summary import summary, summary_document
from threatloom.schema import ALERT_RULE
from threatloom.sources.tables import alert_rules, read_events


@pytest.fixture(scope="module")
def events(spark):
    return set_a(spark).cache()


def test_aggregates(events):
    one = an.filter_events(events, config_id=31)
    assert an.total_events(one).first()[0] == 7
    assert sorted(rows(an.by_category(one), "category", "event_count", "average_threat_score")) == [
        ("BOT", 2, 27.0), ("DOS", 1, 45.0), ("INJECTION", 3, 71.0), ("XSS", 1, 10.0),
    ]
    assert dict(rows(an.by_action(one), "action", "event_count")) == {"DENY": 4, "ALERT": 1, "MONITOR": 2}
    assert rows(an.top_attackers(one), "client_ip", "event_count") == [
        ("192.0.2.200", 3), ("198.51.100.90", 3), ("203.0.113.8", 1),
    ]
    assert rows(an.top_paths(one), "path", "event_count") == [("/admin/audit", 2), ("/basket", 2), ("/login/start", 2), ("/team", 1)]
    assert an.find_by_config(events, 77).count() == 1


def test_summary_equals_its_parts(events):
    one = an.filter_events(events, config_id=31)
    got = sorted(rows(summary(one), "section", "key", "event_count"), key=str)
    parts = [("total", None, 7)] + [("category", *r) for r in rows(an.by_category(one), "category", "event_count")]
    parts += [("action", *r) for r in rows(an.by_action(one), "action", "event_count")]
    parts += [("attacker", *r) for r in rows(an.top_attackers(one), "client_ip", "event_count")]
    parts += [("path", *r) for r in rows(an.top_paths(one), "path", "event_count")]
    assert got == sorted(parts, key=str)


def test_top_lists_are_cut_with_ties_by_key(spark):
    many = [{"event_id": str(i), "client_ip": f"ip-{i % 15:02d}", "path": f"/p{i % 12:02d}", "threat_score": 1, "action": "DENY",
             "category": f"C{i % 14}"} for i in range(60)]
    sections = summary(stored(spark, many))
    attackers = sorted(r[0] for r in rows(sections.filter("section = 'attacker'"), "key"))
    assert attackers == [f"ip-{i:02d}" for i in range(10)]
    assert sorted(r[0] for r in rows(sections.filter("section = 'path'"), "key")) == [f"/p{i:02d}" for i in range(10)]
    assert sections.filter("section = 'category'").count() == 14


def test_missing_category_and_path(spark):
    frame = stored(spark, [{"event_id": "1", "client_ip": "a", "action": "DENY", "threat_score": 5}, {"event_id": "2", "client_ip": "a", "threat_score": 6}])
    assert an.by_category(frame).count() == 0 and rows(an.by_action(frame), "action", "event_count") == [("DENY", 1)]
    got = {(r[0], r[1]): r[2] for r in rows(summary(frame), "section", "key", "event_count")}
    assert got == {("total", None): 2, ("action", "DENY"): 1, ("attacker", "a"): 2, ("path", None): 2}


def test_document(events):
    doc = summary_document(summary(an.filter_events(events, config_id=31))).first()
    assert doc["totalEvents"] == 7 and doc["byAction"] == {"DENY": 4, "ALERT": 1, "MONITOR": 2}
    assert tuple(doc["byCategory"]["INJECTION"]) == (3, 71.0)
    assert [tuple(r) for r in doc["topAttackers"]][:2] == [("192.0.2.200", 3, 71.0), ("198.51.100.90", 3, 33.0)]
    assert [r["path"] for r in doc["topTargetedPaths"]] == ["/admin/audit", "/basket", "/login/start", "/team"]
    empty = summary_document(summary(an.filter_events(events, config_id=1))).first()
    assert empty["totalEvents"] == 0 and empty["byCategory"] == {} and empty["topAttackers"] == []


def test_pages(events):
    one = an.filter_events(events, config_id=31)
    assert rows(an.samples_page(one, limit=2), "event_id") == [("a7",), ("a6",)]
    assert an.samples_total(one).first()[0] == 7
    assert [r[0] for r in rows(an.samples_page(an.filter_events(one, category="INJECTION")), "event_id")] == ["a4", "a2", "a1"]
    assert [r[0] for r in rows(an.samples_page(an.filter_events(one, action="MONITOR")), "event_id")] == ["a7", "a5"]
    assert rows(an.samples_page(one, limit=2, offset=4), "event_id") == [("a3",), ("a2",)]
    assert an.samples_page(one, offset=99).count() == 0


@pytest.mark.parametrize("at_once", [0, 100_000])
def test_pages_of_any_depth(spark, monkeypatch, at_once):
    monkeypatch.setattr(an, "SORTED_AT_ONCE", at_once)
    made = [(f"{i:04d}", f"2025-09-02T{i % 7:02d}:00:{i % 5:02d}.{i % 3}Z") for i in range(300)]
    frame = stored(spark, [{"event_id": i, "timestamp": t} for i, t in made]).cache()
    order = [i for i, _ in sorted(sorted(made), key=lambda r: r[1], reverse=True)]
    for skip in (0, 33, 120, 280, 299, 300):
        assert [r[0] for r in rows(an.samples_page(frame, 50, skip), "event_id")] == order[skip : skip + 50]


def test_page_parameters():
    assert an.clamp_page() == (20, 0) and an.clamp_page(500, -3) == (100, 0) and an.clamp_page(0, 5) == (1, 5)


def test_page_is_a_top_k(events):
    plan = an.samples_page(events)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_category_windows(events):
    def count(category, start, end):
        return an.count_category_within(events, category, f"2025-09-02T{start}Z", f"2025-09-02T{end}Z").first()[0]

    assert count("INJECTION", "10:01:00", "10:08:20") == 3 and count("INJECTION", "10:01:01", "10:08:20") == 2
    assert count("BOT", "10:05:50", "10:11:39") == 1 and count("DATA_LEAKAGE", "10:00:00", "10:30:00") == 1
    assert count("RATE_LIMIT", "10:00:00", "10:30:00") == 0


def test_timeseries(spark):
    frame = stored(spark, [
        {"event_id": str(i), "config_id": c, "timestamp": f"2025-03-11T10:{t}Z"}
        for i, (c, t) in enumerate([(31, "02:10"), (31, "03:40"), (31, "11:00"), (31, "14:59"), (77, "09:30")])
    ])

    def series(interval, **conditions):
        buckets = an.timeseries(an.filter_events(frame, **conditions), interval)
        return [tuple(r) for r in buckets.select(F.date_format("bucket_start", "HH:mm"), "event_count").collect()]

    assert series("5m", config_id=31) == [("10:00", 2), ("10:10", 2)]
    assert [b for b, _ in series("1m", config_id=31)] == ["10:02", "10:03", "10:11", "10:14"]
    assert series("5m", config_id=77) == [("10:05", 1)]
    assert series("5m", config_id=31, start="2025-03-11T10:03:00Z", end="2025-03-11T10:11:00Z") == [("10:00", 1), ("10:10", 1)]
    assert series("1h") == [("10:00", 5)]
    with pytest.raises(ValueError, match="invalid interval: 2h"):
        an.timeseries(frame, "2h")


def test_filters_prune_days_and_columns(spark, tmp_path):
    path = str(tmp_path / "events")
    write_events(set_a(spark).withColumn("event_date", F.to_date("timestamp")), path)
    chosen = an.filter_events(read_events(spark, path), 31, "2025-09-02T10:03:00Z", "2025-09-02T10:10:00Z")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = an.by_category(chosen)._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    assert "EqualTo(config_id,31)" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert re.search(r"ReadSchema: struct<(.*?)>", plan).group(1) == (
        "timestamp:timestamp,config_id:int,category:string,threat_score:int"
    )
    assert an.total_events(chosen).first()[0] == 3


def test_alerts(spark):
    frame = stored(spark, [
        {"event_id": str(i), "category": c, "timestamp": f"2025-03-11T{t}:00Z", "config_id": i}
        for i, (c, t) in enumerate([("INJECTION", "08:49"), ("INJECTION", "08:52"), ("INJECTION", "08:55"),
                                    ("INJECTION", "08:59"), ("BOT", "08:50"), ("XSS", "08:57")])
    ])
    table = alert_rules(spark, [
        ("i3", "INJECTION", 3, 10), ("i4", "INJECTION", 4, 10), ("i2m", "INJECTION", 3, 2), ("b1", "BOT", 1, 10),
        ("b2", "BOT", 2, 10), ("b9", "BOT", 1, 9), ("x", "XSS", 1, 10), ("d", "DOS", 1, 10),
    ])
    got = evaluate_alerts(frame, table, "2025-03-11T09:00:00Z")
    assert {r[0]: r[1:] for r in rows(got, "rule_id", "event_count", "firing")} == {
        "i3": (3, True), "i4": (3, False), "i2m": (1, False), "b1": (1, True), "b2": (1, False), "b9": (0, False),
        "x": (1, True), "d": (0, False),
    }
    assert evaluate_alerts(frame, spark.createDataFrame([], ALERT_RULE), "2025-03-11T09:00:00Z").count() == 0
    bounds = got.filter("rule_id = 'i2m'").select(F.date_format("window_from", "HH:mm"), F.date_format("window_to", "HH:mm"))
    assert tuple(bounds.first()) == ("08:58", "09:00")


def test_alert_rule_validation(spark):
    table = spark.createDataFrame([("a", "XSS", 1, 1), ("b", "NOPE", 0, 0), (" ", None, None, 5)], ALERT_RULE)
    got = {r[0]: [v["field"] for v in r[1]] for r in rows(validate_alert_rules(table), "id", "violations")}
    assert got == {"a": [], "b": ["category", "threshold", "windowMinutes"], " ": ["id", "category", "threshold"]}
    assert alert_rules(spark, [(None, "XSS", 1, 1)]).first()["id"]


def test_scalars(spark):
    values = [(45.25, 45.3), (45.24, 45.2), (0.05, 0.1), (77.5, 77.5)]
    frame = spark.createDataFrame(values, "v double, r double")
    assert all(a == b for a, b in rows(frame.select(round1(F.col("v")).alias("a"), "r"), "a", "r"))
    hops = [(" 1.1.1.1 , 2.2.2.2", "1.1.1.1"), ("  ", "peer"), (None, "peer"), (" ,2.2.2.2", ""), ("3.3.3.3", "3.3.3.3")]
    frame = spark.createDataFrame(hops, "h string, r string")
    assert all(a == b for a, b in rows(frame.select(client_key(F.col("h"), F.lit("peer")).alias("a"), "r"), "a", "r"))
