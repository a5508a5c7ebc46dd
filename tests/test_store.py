import json
import re

import pytest
from build import raw_events, rows, set_a, stored
from pyspark.sql import functions as F

from threatloom.operators import id_index, shape, store
from threatloom.operators.enrich import enrich
from threatloom.sources.tables import default_rules, read_events


def test_first_write_wins(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append_once(set_a(spark), path)
    store.append_once(set_a(spark), path)
    changed = set_a(spark).withColumn("threat_score", F.lit(1)).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 2 DAYS"))
    store.append_once(changed, path)
    table = read_events(spark, path)
    assert store.count_all(table).first()[0] == 8 and table.filter("threat_score = 1").count() == 0
    extra = stored(spark, [{"event_id": "n", "timestamp": "2025-09-02T10:00:00Z", "received_at": f"2025-09-02T10:00:0{s}Z",
                            "threat_score": s, "client_ip": "x", "action": "DENY", "config_id": 1} for s in (5, 3, 4)])
    store.append_once(extra.unionByName(set_a(spark)), path, ids_keep_their_day=True)
    table = read_events(spark, path)
    assert table.count() == 9 and rows(table.filter("event_id = 'n'"), "threat_score") == [(3,)]


def test_only_the_days_of_a_batch_are_searched(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append_once(set_a(spark), path)
    later = set_a(spark).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 2 DAYS"))
    store.append_once(later, path, ids_keep_their_day=True)
    assert read_events(spark, path).count() == 16


def _later(frame, days):
    return frame.withColumn("timestamp", F.col("timestamp") + F.expr(f"INTERVAL {days} DAYS"))


def test_a_batch_that_fails_before_its_index_entries(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    store.append_once(set_a(spark).filter("event_id < 'a4'"), path)

    def lost(*_):
        raise OSError("executor lost")

    with monkeypatch.context() as patched, pytest.raises(OSError):
        patched.setattr(id_index, "add", lost)
        store.append_once(set_a(spark), path)
    store.append_once(set_a(spark), path)
    assert read_events(spark, path).count() == 8
    store.append_once(_later(set_a(spark), 30), path)
    assert read_events(spark, path).count() == 8


def test_only_buckets_of_a_batch_are_opened(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append_once(set_a(spark), path)
    generation = id_index.newest(spark, path)
    asked = set_a(spark).filter("event_id = 'a5'").select("event_id")
    found = id_index.held(spark, path, generation, asked)
    assert rows(found, "event_id") == [("a5",)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "event_date" not in plan
    assert len(found.inputFiles()) > 1 and found.select("event_id").count() == 1
    again = id_index.rebuild(spark.read.schema("event_id string").parquet(f"{path}/_ids/held/generation={generation}"), path)
    assert id_index.newest(spark, path) == again == generation + 1
    store.append_once(_later(set_a(spark), 3), path)
    assert read_events(spark, path).count() == 8


def test_index_of_a_table_written_without_one(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append_once(set_a(spark), path, ids_keep_their_day=True)
    assert id_index.newest(spark, path) is None
    store.append_once(_later(set_a(spark), 9), path)
    assert read_events(spark, path).count() == 8 and id_index.newest(spark, path) == 1


def test_many_copies_of_one_event(spark, tmp_path):
    path = str(tmp_path / "events")
    copies = set_a(spark).filter("event_id = 'a1'").crossJoin(spark.range(500)).drop("id")
    store.append_once(copies.unionByName(set_a(spark)), path)
    assert read_events(spark, path).count() == 8


def test_flat_and_nested(spark):
    flat = shape.to_stored(enrich(raw_events(spark, [{"country": "CN"}, {"eventId": "e2"}]), default_rules(spark)))
    first, second = flat.orderBy("event_id").collect()
    assert first["event_id"] == "e2" and first["geo_country"] is None and second["geo_country"] == "CN"
    assert second["rule_name"] == "sig-one" and second["attack_type"] == "SQL/Command Injection" and len(second) == 23
    blank = shape.to_stored(enrich(raw_events(spark, [{"eventId": "  "}]), default_rules(spark)))
    assert blank.count() == 0


def test_null_structs(spark):
    frame = stored(spark, [{"event_id": "1", "geo_city": "Rome"}, {"event_id": "2", "severity": "LOW"}])
    one, two = shape.to_nested(frame).orderBy("eventId").collect()
    assert one["rule"] is None and one["geoLocation"]["country"] is None and one["geoLocation"]["city"] == "Rome"
    assert two["rule"]["severity"] == "LOW" and two["geoLocation"] is None
    one, two = shape.to_response(frame).orderBy("eventId").collect()
    assert one["rule"]["id"] is None and two["geoLocation"]["city"] is None


def test_json_export(spark, tmp_path):
    path = tmp_path / "out"
    store.export_json(shape.to_response(set_a(spark)), str(path))
    lines = [json.loads(line) for file in path.glob("part-*") for line in file.read_text().splitlines()]
    assert len(lines) == 8 and {line["eventId"] for line in lines} == {*(f"a{i}" for i in range(1, 8)), "b1"}
    assert all(line["timestamp"].endswith("Z") for line in lines)
