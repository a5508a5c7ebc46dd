"""Hourly rows against the events themselves, whatever part of the table they cover."""

import glob
import os
import random

import pytest
from build import rows, stored
from pyspark.sql import functions as F

from threatloom.operators import analytics as an
from threatloom.operators import rollup, store
from threatloom.sources.tables import read_events


@pytest.fixture(scope="module")
def made():
    random.seed(5)
    at = lambda: f"2025-03-{random.randrange(9, 12):02d}T{random.randrange(24):02d}:{random.choice(['00:00', '59:59.999999', '30:00'])}Z"
    return [
        {"event_id": f"{i:04d}", "timestamp": at(), "config_id": random.choice([1, 2]), "threat_score": random.choice([None, 3, 50]),
         "category": random.choice(["BOT", "XSS", None]), "action": random.choice(["DENY", None])} for i in range(400)
    ]


RANGES = [
    {}, {"start": "2025-03-10T00:00:00Z"}, {"end": "2025-03-10T05:30:00Z"}, {"start": "2025-03-09T03:00:01Z", "end": "2025-03-11T20:30:00Z"},
    {"start": "2025-03-10T03:10:00Z", "end": "2025-03-10T03:40:00Z"}, {"start": "2025-03-10T03:30:00Z", "end": "2025-03-10T04:30:00Z"},
    {"start": "2025-03-10T09:00:00Z", "end": "2025-03-10T09:59:59.999999Z"}, {"start": "2025-03-11T00:00:00Z", "end": "2025-03-10T00:00:00Z"},
    {"config_id": 2, "category": "BOT", "action": "DENY", "start": "2025-03-09T12:30:00Z"},
]


def plain(frame):
    return sorted(map(repr, frame.collect()))


def check(spark, path, ranges=(RANGES[3], RANGES[8])):
    events = read_events(spark, path)
    added = lambda hours: hours.groupBy(*rollup.KEYS).agg(F.sum("event_count"), F.sum("score_sum"), F.sum("scored"))
    for bounds in ranges:
        assert plain(added(rollup.rolled(spark, path, **bounds))) == plain(added(rollup.hourly(an.filter_events(events, **bounds)))), bounds


def check_questions(spark, path):
    for bounds in RANGES[3:4]:
        of, hours = an.filter_events(read_events(spark, path), **bounds), rollup.rolled(spark, path, **bounds)
        assert rollup.total(hours).first()[0] == of.count()
        assert plain(rollup.by_category(hours)) == plain(an.by_category(of))
        assert plain(rollup.by_action(hours)) == plain(an.by_action(of))
        assert rollup.timeseries(hours).collect() == an.timeseries(of).collect()


def test_counts_agree_at_every_stage(spark, made, tmp_path):
    path = str(tmp_path / "events")
    frame = stored(spark, made).withColumn("event_date", F.to_date("timestamp")).cache()
    store.write_events(frame.filter("event_id < '0250'"), path)
    check(spark, path)
    assert rollup.refresh(spark, path) > 0 and rollup.refresh(spark, path) == 0
    store.write_events(frame.filter("event_id >= '0250'"), path)
    check(spark, path, RANGES)
    rollup.refresh(spark, path)
    assert read_events(spark, path).count() == 400
    check_questions(spark, path)
    os.remove(glob.glob(f"{path}/event_date=2025-03-10/*.parquet")[0])
    check(spark, path)


def test_pages_from_counts(spark, made, tmp_path):
    path = str(tmp_path / "events")
    store.write_events(stored(spark, made).withColumn("event_date", F.to_date("timestamp")), path)
    rollup.refresh(spark, path)
    events = read_events(spark, path)
    order = [r["event_id"] for r in sorted(sorted(made, key=lambda r: r["event_id"]), key=lambda r: (r["timestamp"][:13], r["timestamp"][14:]), reverse=True)]
    key = {r["event_id"]: r["timestamp"] for r in made}
    for skip in (0, 100, 390, 400):
        page = an.samples_page(events, 30, skip, rollup.rolled(spark, path))
        found = [r[0] for r in rows(page, "event_id")]
        assert found == order[skip : skip + 30] and [key[i] for i in found] == sorted((key[i] for i in found), reverse=True)
    plan = an.samples_page(events, 5, 0, rollup.rolled(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "event_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    hours = rollup.per_hour(rollup.rolled(spark, path))
    assert an.samples_page(events, 30, 100, hours).collect() == an.samples_page(events, 30, 100).collect()
    one = an.filter_events(events, config_id=2, category="BOT")
    assert an.samples_page(one, 20, 7, rollup.rolled(spark, path, config_id=2, category="BOT")).collect() == an.samples_page(one, 20, 7).collect()


def test_empty_table_and_intervals(spark, made, tmp_path):
    path = str(tmp_path / "events")
    store.write_events(stored(spark, made[:1]).withColumn("event_date", F.to_date("timestamp")).limit(0), path)
    assert rollup.refresh(spark, path) == 0 and rollup.total(rollup.rolled(spark, path)).first()[0] == 0
    with pytest.raises(ValueError, match="5m"):
        rollup.timeseries(rollup.rolled(spark, path), "5m")
