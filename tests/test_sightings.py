from pathlib import Path

from build import raw_events, rows
from pyspark.sql import functions as F
from test_streams import run

from threatloom.operators.enrich import enrich
from threatloom.operators.shape import to_stored
from threatloom.plans.queries import _envelopes
from threatloom.sources.tables import default_rules, read_events
from threatloom.streaming import enrichment, logs

HOURS = 150


def hourly(spark, minutes, arrival=0, again=False):
    """An event of one client at these minutes of each of many hours; `again`: under the ids of the minute 0."""
    made = [(hour, minute) for minute in minutes for hour in range(HOURS)]
    return raw_events(
        spark,
        [
            {"eventId": f"k-{hour}-{0 if again else minute}", "arrival": arrival + i,
             "received_at": f"2025-03-{1 + hour // 24:02d}T{hour % 24:02d}:{minute:02d}:00Z"}
            for i, (hour, minute) in enumerate(made)
        ],
    )


def seen(raw):
    return raw.selectExpr("rawEvent.eventId AS event_id", "rawEvent.clientIp AS client", "received_at", "arrival")


def test_a_batch_of_many_hours_writes_few_files_and_later_ones_find_them(spark, tmp_path):
    base = str(tmp_path)
    first, second = hourly(spark, [0, 2]), hourly(spark, [4], 1000).unionByName(hourly(spark, [6], 2000, again=True))
    for part in (first, second):
        logs.write_log(logs.raw_messages(_envelopes(part.withColumn("payload", F.col("rawEvent")))), f"{base}/log")
        run(spark, base, lambda: default_rules(spark))
    for batch in (0, 1):
        files = list(Path(base, "seen").glob(f"hour=*/batch={batch}/*.parquet"))
        assert 1 < len(files) <= 75, batch  # a file for each hour, or one for each hour and task, are 150 and more
    expected = to_stored(enrich(first.unionByName(second), default_rules(spark)))
    got = read_events(spark, f"{base}/events").drop("event_date")
    assert got.count() == 3 * HOURS and got.exceptAll(expected).count() == 0


def test_folders_of_several_hours_give_the_sightings_of_the_asked_hours_only(spark, tmp_path):
    path, raw = str(tmp_path / "seen"), hourly(spark, [0, 30])
    start = rows(raw.agg(F.min(F.unix_micros("received_at"))), "*")[0][0] // 3_600_000_000
    before = raw.withColumn("received_at", F.col("received_at") - F.expr("INTERVAL 70 YEARS"))
    enrichment.record_sightings(raw.filter("arrival < 4"), 0, path)  # a folder for each hour
    enrichment.record_sightings(raw, 1, path, enrichment.further_hours(start, start + HOURS - 1))
    enrichment.record_sightings(before, 2, path, 7)
    enrichment.record_sightings(raw, 3, path, 3)

    def found(first, last):
        held = enrichment.earlier_sightings(spark, path, 3, first, last)
        return rows(held.orderBy("received_at", "batch", "arrival"), "received_at", "batch", "arrival")

    assert len(found(start, start + HOURS - 1)) == 2 * HOURS + 4
    assert [r[1:] for r in found(start + 1, start + 3)] == [(0, 1), (1, 1), (1, 151), (0, 2), (1, 2), (1, 152), (0, 3), (1, 3), (1, 153)]
    old = rows(before.agg(F.min(F.unix_micros("received_at"))), "*")[0][0] // 3_600_000_000
    assert old < 0 and [r[1:] for r in found(old + 13, old + 13)] == [(2, 13), (2, 163)]


def test_hours_of_a_folder():
    assert [enrichment.further_hours(5, 5 + n) for n in (0, 63, 64, 127, 128, 1666)] == [0, 0, 1, 1, 3, 31]
    assert all((last // (n + 1)) + 1 <= 65 for last in range(1, 5000) for n in [enrichment.further_hours(0, last)])
