import shutil

import pytest
from build import raw_events, rows, stored
from pyspark.sql import functions as F

from threatloom.operators.enrich import enrich
from threatloom.operators.quota import flag_quota
from threatloom.operators.shape import to_stored
from threatloom.plans.queries import _envelopes, _replay, _start_keyed
from threatloom.schema import EVENTS
from threatloom.sources.tables import alert_rules, default_rules, read_events
from threatloom.streaming import enrichment, live, logs, state


def events(spark, start, end):
    """Nine events a minute apart per client and batch, later ones repeating earlier ids."""
    return raw_events(
        spark,
        [
            {
                "eventId": f"k-{i % 40}", "clientIp": f"203.0.113.{i % 2}", "arrival": i,
                "received_at": f"2025-03-11T14:{(i % 40) // 2:02d}:00Z", "timestamp": f"2025-03-11T13:{i % 40:02d}:10Z",
            }
            for i in range(start, end)
        ],
    )


def deliver(spark, base, start, end):
    raw = events(spark, start, end).withColumn("payload", F.col("rawEvent"))
    logs.write_log(logs.raw_messages(_envelopes(raw)).coalesce(1), f"{base}/log")


def run(spark, base, rules, **options):
    query = enrichment.start_enrichment(
        logs.read_folder(spark, f"{base}/log"), f"{base}/events", f"{base}/seen", f"{base}/checkpoint", rules, _replay,
        available_now=True, **options,
    )
    query.awaitTermination()


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    base = str(tmp_path)
    for start, end in ((0, 14), (14, 30), (30, 46)):
        deliver(spark, base, start, end)
        run(spark, base, lambda: default_rules(spark))
    expected = to_stored(enrich(events(spark, 0, 46), default_rules(spark)))
    got = read_events(spark, f"{base}/events").drop("event_date")
    assert got.count() == 40 and got.exceptAll(expected).count() == 0


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    """The process dies after the tables were written but before the checkpoint knew."""
    base = str(tmp_path)
    deliver(spark, base, 0, 20)
    run(spark, base, lambda: default_rules(spark))
    deliver(spark, base, 20, 40)
    shutil.copytree(f"{base}/checkpoint", f"{base}/checkpoint-before")
    run(spark, base, lambda: default_rules(spark))
    before = rows(read_events(spark, f"{base}/events").orderBy("event_id"), "event_id", "threat_score")
    query = enrichment.start_enrichment(
        logs.read_folder(spark, f"{base}/log"), f"{base}/events", f"{base}/seen", f"{base}/checkpoint-before",
        lambda: default_rules(spark), _replay, available_now=True,
    )
    query.awaitTermination()
    again = rows(read_events(spark, f"{base}/events").orderBy("event_id"), "event_id", "threat_score")
    assert again == before and len(again) == 40
    assert spark.read.parquet(f"{base}/seen").count() == 40


def test_rule_edits_apply_to_the_next_batch(spark, tmp_path):
    base, table = str(tmp_path), [default_rules(spark)]
    deliver(spark, base, 0, 10)
    run(spark, base, lambda: table[0])
    table[0] = table[0].limit(0)
    deliver(spark, base, 10, 20)
    run(spark, base, lambda: table[0])
    scored = dict(rows(read_events(spark, f"{base}/events"), "event_id", "threat_score"))
    assert all((scored[f"k-{i}"] > 0) == (i < 10) for i in range(20))


def test_an_id_is_new_again_after_an_hour(spark, tmp_path):
    times = ["14:00:00", "14:59:59", "15:00:00"]
    raw = raw_events(spark, [{"received_at": f"2025-03-11T{t}Z"} for t in times])
    earlier = raw.limit(1).selectExpr("'k-1' AS event_id", "'x' AS client", "received_at", "arrival").filter("arrival = 0")
    later = raw.filter("arrival > 0")
    assert rows(enrichment.first_sights(later.filter("arrival = 1"), earlier), "arrival") == []
    assert rows(enrichment.first_sights(later.filter("arrival = 2"), earlier), "arrival") == [(2,)]


def test_the_cut_into_batches_changes_no_first_sight(spark):
    """Copies of one id up to three hours apart, two of them at one instant."""
    times = ["14:00", "14:59", "15:00", "15:00", "15:30", "16:10", "17:09", "17:10"]
    raw = raw_events(spark, [{"received_at": f"2025-03-11T{t}:00Z"} for t in times]).cache()
    seen = "rawEvent.eventId AS event_id", "rawEvent.clientIp AS client", "received_at", "arrival"
    none = raw.limit(0).selectExpr(*seen)
    whole = [r[0] for r in rows(enrichment.first_sights(raw, none).orderBy("arrival"), "arrival")]
    assert whole == [0, 2, 5, 7]
    for cut in (1, 3, 5, 6):
        first = enrichment.first_sights(raw.filter(F.col("arrival") < cut), none).cache()
        later = enrichment.first_sights(raw.filter(F.col("arrival") >= cut), first.selectExpr(*seen))
        assert sorted(r[0] for r in rows(first, "arrival") + rows(later, "arrival")) == whole


def test_records_of_two_partitions_have_positions_of_their_own(spark):
    made = "named_struct('key', '', 'value', binary(''))"
    records = spark.range(6).selectExpr(
        "'k' AS key", "'v' AS value", f"filter(array({made}), x -> false) AS headers", "int(id % 2) AS partition", "id div 2 AS offset"
    )
    placed = [r[0] for r in rows(logs.kafka_messages(records), "arrival")]
    assert len(set(placed)) == 6 and placed[::2] == sorted(placed[::2]) and placed[1::2] == sorted(placed[1::2])
    with pytest.raises(Exception, match="partition number"):
        logs.kafka_messages(records, partitions=1).collect()


def test_alerts_after_each_batch(spark, tmp_path):
    base, seen = str(tmp_path), []
    rules = alert_rules(spark, [("a", "INJECTION", 15, 60)])
    hook = live.alerts_after_batch(
        f"{base}/events", lambda: rules, lambda df, i: seen.append(rows(df, "event_count", "firing")[0]), lambda: "2025-03-11T13:59:59Z"
    )
    for start, end in ((0, 10), (10, 20)):
        deliver(spark, base, start, end)
        run(spark, base, lambda: default_rules(spark), publish=hook)
    assert seen == [(10, False), (20, True)]


def test_keyed_count_and_quota(spark, tmp_path):
    base = str(tmp_path)
    query = None
    for start, end in ((0, 14), (14, 40)):
        deliver(spark, base, start, end)
        source = _replay(logs.read_folder(spark, f"{base}/log"))
        keyed = source.select(
            F.col("rawEvent.clientIp").alias("client"), "received_at", "arrival", F.col("rawEvent.eventId").alias("event_id")
        )
        query = _start_keyed(state.rolling_count(state.once_within_retention(keyed, "event_id")), f"{base}/count")
        query.awaitTermination()
        access = source.select(F.col("rawEvent.clientIp").alias("client"), F.col("received_at").alias("ts"), "arrival")
        _start_keyed(state.quota_stream(access, 2, 240), f"{base}/quota").awaitTermination()
    batch = enrich(events(spark, 0, 40), default_rules(spark)).select("arrival", "offenderEventCount")
    got = spark.read.parquet(f"{base}/count/out").select("arrival", "offenderEventCount")
    assert got.count() == 40 and got.exceptAll(batch).count() == 0
    log = events(spark, 0, 40).select(F.col("rawEvent.clientIp").alias("client"), F.col("received_at").alias("ts"), "arrival")
    flags = flag_quota(log, F.col("client"), F.col("ts"), 2, 240).select("arrival", "request_number", "allowed")
    got = spark.read.parquet(f"{base}/quota/out").select("arrival", "request_number", "allowed")
    assert got.count() == 40 and got.exceptAll(flags).count() == 0


def test_live_timeseries(spark, tmp_path):
    base = str(tmp_path)
    for day in ("06", "05"):  # the second delivery is older than the first
        rows_ = [{"event_id": f"{day}{i}", "timestamp": f"2026-07-{day}T09:{i:02d}:00Z"} for i in range(10)]
        table = stored(spark, rows_).withColumn("event_date", F.to_date("timestamp")).select(*EVENTS.names)
        table.write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(EVENTS).parquet(f"{base}/events")
        live.start_timeseries(stream, f"{base}/series", f"{base}/checkpoint", "5m", availableNow=True).awaitTermination()
    series = live.read_timeseries(spark, f"{base}/series").select(F.date_format("bucket_start", "dd HH:mm"), "event_count")
    assert sorted(tuple(r) for r in series.collect()) == [("05 09:00", 5), ("05 09:05", 5), ("06 09:00", 5), ("06 09:05", 5)]
