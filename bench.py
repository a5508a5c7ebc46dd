"""Headline timings as one JSON line.

The write path runs over the raw events of $BENCH_SF_DIR and fills an event table; the read
path then asks that table. Each figure is the median of three runs after one warm-up run,
except for the streams, which run once.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from threatloom.operators import alerts, analytics, ingest, rollup, store, summary  # noqa: E402
from threatloom.operators.enrich import enrich  # noqa: E402
from threatloom.operators.shape import to_stored  # noqa: E402
from threatloom.plans import queries as q  # noqa: E402
from threatloom.plans.sql import ALERT_RULES, ALERTS_AS_OF  # noqa: E402
from threatloom.session import local_session, scratch_dir  # noqa: E402
from threatloom.sources import tables, testdata  # noqa: E402
from threatloom.streaming import enrichment, logs  # noqa: E402

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}

    def timed(name: str, action, runs: int = RUNS) -> None:
        if runs > 1:
            action()
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            action()
            taken.append(time.perf_counter() - began)
        timings[name] = round(statistics.median(taken), 4)
        print(name, timings[name], file=sys.stderr, flush=True)

    def consume(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    rules = tables.default_rules(spark)
    raw = testdata.raw_events(spark, sf_dir)
    messages = testdata.ingest_messages(spark, sf_dir).select("value", "correlation", "arrival").persist()
    events_count = raw.count()
    messages.count()

    timed("ingest_validate", lambda: consume(ingest.accepted(ingest.check_messages(messages))))
    timed("threat_score", lambda: consume(q.threat_score(spark, sf_dir)))
    timed("first_sight", lambda: consume(q.first_sights(spark, sf_dir)))
    timed("offender_count", lambda: consume(q.offender(False, spark, sf_dir)))
    timed("enrich", lambda: consume(enrich(testdata.with_redeliveries(raw), rules)))

    written: list[str] = []

    def persist_events() -> None:
        written.append(scratch_dir(spark, "bench-events"))
        store.append_once(to_stored(enrich(raw, rules)), written[-1])

    timed("enrich_and_append", persist_events)
    hours: list = []

    def count_hours() -> None:  # once after an append; pages read it
        rollup.refresh(spark, written[-1])
        hours.append(rollup.per_hour(rollup.rolled(spark, written[-1], testdata.CONFIG_IDS[0])).persist())
        hours[-1].count()

    timed("rollup_refresh", count_hours, runs=1)
    events = tables.read_events(spark, written[-1])
    config = analytics.filter_events(events, config_id=testdata.CONFIG_IDS[0])
    questions = {
        "summary": lambda: summary.summary(events),
        "summary_one_config": lambda: summary.summary(config),
        "by_category": lambda: analytics.by_category(events),
        "by_action": lambda: analytics.by_action(events),
        "top_attackers": lambda: analytics.top_attackers(events),
        "top_paths": lambda: analytics.top_paths(events),
        "samples_page": lambda: analytics.samples_page(config, counts=hours[-1]),
        "samples_total": lambda: analytics.samples_total(config),
        "timeseries_1m": lambda: analytics.timeseries(events, "1m"),
        "timeseries_1h": lambda: analytics.timeseries(config, "1h"),
        "alerts": lambda: alerts.evaluate_alerts(events, tables.alert_rules(spark, ALERT_RULES), ALERTS_AS_OF),
    }
    for name, question in questions.items():
        timed(name, lambda question=question: question().collect())
    timed("quota_flags", lambda: consume(q.quota_flags(spark, sf_dir)), runs=1)

    base = scratch_dir(spark, "bench-stream")
    log = logs.raw_messages(q._envelopes(raw.withColumn("payload", F.col("rawEvent"))))
    logs.write_log(log.repartition(8), f"{base}/log")

    def stream() -> None:
        enrichment.start_enrichment(
            logs.read_folder(spark, f"{base}/log"), f"{base}/events", f"{base}/sightings", f"{base}/checkpoint",
            lambda: rules, q._replay, available_now=True,
        ).awaitTermination()

    timed("stream_enrich", stream, runs=1)
    stored = tables.read_events(spark, f"{base}/events").count()
    if stored != events_count:
        raise RuntimeError(f"the stream stored {stored} of {events_count} events")

    print(
        json.dumps(
            {
                "metric": "total seconds of all headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events_count,
                "events_per_second": {
                    name: round(events_count / timings[name]) for name in ("enrich", "enrich_and_append", "stream_enrich")
                },
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
