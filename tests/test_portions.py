from pathlib import Path

from build import rows
from pyspark.sql import functions as F

from threatloom.schema import MESSAGE
from threatloom.streaming import gateway, logs

EVENT = (
    '{"eventId":"%d","timestamp":"2025-03-11T08:07:06Z","configId":31,"clientIp":"192.0.2.200","path":"/team","statusCode":410,'
    '"rule":{"id":"1","name":"n","message":"m","severity":"LOW","category":"XSS"},"action":"DENY"}'
)


def ingest(spark, base):
    log = logs.read_folder(spark, f"{base}/log")
    gateway.start_ingest(log, f"{base}/raw", f"{base}/refused", f"{base}/checkpoint", available_now=True).awaitTermination()


def deliver(spark, base):
    """Forty messages in one file, every tenth cut short, one of them without text and two without a position."""
    made = [(None, (EVENT % i)[: 30 if i % 10 == 3 else None], f"c-{i}", i) for i in range(38)]
    made += [(None, None, "c-38", None), (None, EVENT % 39, "c-39", None)]
    logs.write_log(spark.createDataFrame(made, MESSAGE).coalesce(1), f"{base}/log")


def test_a_large_file_is_parsed_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "PORTION", 1000)
    base = str(tmp_path)
    deliver(spark, base)
    ingest(spark, base)
    files = [part.stat() for part in Path(base, "raw").glob("batch=0/*.parquet")]
    assert len(files) >= 4  # one, where the task that reads the file keeps all of it
    per_file = spark.read.parquet(f"{base}/raw").groupBy(F.input_file_name()).count()
    assert max(n for n, in rows(per_file, "count")) <= 5
    events = logs.good(logs.read_raw(spark.read.schema(MESSAGE).parquet(f"{base}/raw")))
    told = sorted((int(r[0]), r[1]) for r in rows(events, "payload.eventId", "correlationId"))
    assert told == [(i, f"c-{i}") for i in [*range(38), 39] if i % 10 != 3]
    refused = rows(spark.read.parquet(f"{base}/refused").orderBy(F.asc_nulls_last("arrival")), "arrival")
    assert refused == [(3,), (13,), (23,), (33,), (None,)]


def test_a_small_batch_stays_as_it_is(spark, tmp_path):
    base = str(tmp_path)
    deliver(spark, base)
    messages = spark.read.schema(MESSAGE).parquet(f"{base}/log")
    assert logs.portions(messages) is messages
    assert logs.portions(messages.limit(0)).count() == 0
