import time
from pathlib import Path

import pytest
from build import raw_events, rows, set_a
from pyspark.sql import functions as F
from test_streams import run

from threatloom.operators import id_index, store
from threatloom.operators.enrich import enrich
from threatloom.operators.parts import PART, lay_out, part_of, split
from threatloom.operators.shape import to_stored
from threatloom.plans.queries import _envelopes
from threatloom.session import free_shuffles
from threatloom.sources.tables import default_rules, read_events
from threatloom.streaming import enrichment, logs

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files that are not in `before`; those of an ended query go a moment later."""
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    return shuffle_files(spark) - before


def cached_frames(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def deliver(spark, base, raw, log="log"):
    logs.write_log(logs.raw_messages(_envelopes(raw.withColumn("payload", F.col("rawEvent")))), f"{base}/{log}")


def clients(spark, ids, arrival=0):
    """Events of five clients, one without an address; each in two copies, of which some agree in everything."""
    made = [
        {"eventId": f"k-{i}", "clientIp": None if i % 5 == 0 else f"203.0.113.{i % 5}", "arrival": arrival + i + (1000 if copy and i % 2 else 0),
         "received_at": f"2025-03-11T14:{i % 60:02d}:00Z", "timestamp": f"2025-03-{11 + i % 3}T13:{i % 60:02d}:10Z"}
        for i in ids for copy in (0, 1)
    ]
    return raw_events(spark, made)


def publishing(spark, base, publish):
    """The write path with receipt times of the messages, keeping what envelopes need."""

    def replay(messages):
        return enrichment.received(messages).withColumn("received_at", F.col("occurredAt"))

    enrichment.start_enrichment(
        logs.read_folder(spark, f"{base}/log"), f"{base}/events", f"{base}/seen", f"{base}/checkpoint",
        lambda: default_rules(spark), replay, publish=publish, available_now=True,
    ).awaitTermination()


@pytest.mark.parametrize("part", [20000, 1 << 30])
def test_a_batch_in_parts_gives_the_rows_of_a_whole_one(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(logs, "PART", part)
    base, published = str(tmp_path), []
    first, second = clients(spark, range(60)), clients(spark, range(40, 80), arrival=5000)
    for raw in (first, second):
        deliver(spark, base, raw)
        run(spark, base, lambda: default_rules(spark), publish=lambda df, i: published.append((i, to_stored(df).collect())))
    expected = to_stored(enrich(first.unionByName(second).dropDuplicates(["arrival"]), default_rules(spark)))
    got = read_events(spark, f"{base}/events").drop("event_date")
    assert got.count() == 80 and got.exceptAll(expected).count() == 0
    assert [(i, len(told)) for i, told in published] == [(0, 60), (1, 20)]  # once a batch, all of its rows
    assert {row for _, told in published for row in told} == set(got.collect())
    assert not Path(base, "checkpoint-open").exists()


def test_a_batch_leaves_neither_cached_rows_nor_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "PART", 30000)
    base, seen = str(tmp_path), []
    deliver(spark, base, clients(spark, range(60)))
    before, cached = shuffle_files(spark), cached_frames(spark)

    def publish(enriched, _):
        seen.append((left_over(spark, before), cached_frames(spark) - cached))

    publishing(spark, base, publish)
    assert seen == [(set(), 0)] and not Path(base, "checkpoint-open").exists()
    assert spark.conf.get(SETTING, "false") == "false"  # a stream's session is its own


def test_a_frame_cached_before_its_shuffle_files_went_can_be_made_again(spark):
    session = spark.newSession()
    free_shuffles(session)
    counted = session.range(1000).groupBy((F.col("id") % 7).alias("k")).count().persist()
    assert counted.count() == 7
    counted.unpersist(blocking=True)
    assert counted.agg(F.sum("count")).first()[0] == 1000


def test_a_first_batch_without_ids(spark, tmp_path):
    base = str(tmp_path)
    deliver(spark, base, raw_events(spark, [{"eventId": None}, {"eventId": None}]))
    run(spark, base, lambda: default_rules(spark))
    deliver(spark, base, raw_events(spark, [{"eventId": "k-1", "arrival": 5}]))
    run(spark, base, lambda: default_rules(spark))
    assert rows(read_events(spark, f"{base}/events"), "event_id") == [("k-1",)]


@pytest.mark.parametrize("ids_keep_their_day", [True, False])
def test_parts_are_appended_like_one_batch(spark, tmp_path, ids_keep_their_day):
    path, work = str(tmp_path / "events"), str(tmp_path / "open")
    store.append_once(set_a(spark).filter("event_id < 'a4'"), path, ids_keep_their_day)
    batch = set_a(spark).unionByName(set_a(spark).filter("event_id > 'a5'"))
    for _ in range(2):
        laid_out = lay_out(batch, work, F.col("event_id"), 8)
        assert laid_out.filter(F.col(PART) != part_of(F.col("event_id"), 8)).count() == 0 and laid_out.count() == batch.count()
        store.append_parts(split(laid_out, 8), path, ids_keep_their_day)
        got = read_events(spark, path).drop("event_date")
        assert got.count() == 8 and got.exceptAll(set_a(spark)).count() == 0
    if not ids_keep_their_day:
        held = id_index.held(spark, path, id_index.newest(spark, path), set_a(spark).select("event_id"))
        assert sorted(rows(held.distinct(), "event_id")) == sorted(rows(set_a(spark), "event_id"))


def test_a_column_without_a_type_can_be_laid_out(spark, tmp_path):
    made = spark.range(20).select(F.col("id").cast("string").alias("event_id"), F.lit(None).alias("nothing"))
    assert lay_out(made, str(tmp_path / "open"), F.col("event_id"), 4).filter("nothing IS NULL").count() == 20


def test_parts_follow_the_text(spark, monkeypatch):
    messages = spark.range(10).selectExpr("repeat('é', 50) AS value")  # 1,000 bytes
    told = []
    for size in (1 << 30, 1000, 999, 334, 250, 1):
        monkeypatch.setattr(logs, "PART", size)
        told.append(logs.parts(messages))
    assert told == [1, 1, 2, 4, 4, 64] and logs.parts(messages.limit(0)) == 1
