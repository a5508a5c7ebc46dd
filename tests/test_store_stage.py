from pathlib import Path

from build import rows
from pyspark.sql import functions as F
from test_parts import cached_frames, clients, deliver, left_over, publishing, shuffle_files

from threatloom.operators import store
from threatloom.sources.tables import read_events
from threatloom.streaming import logs, storing


def test_the_store_stage_in_parts(spark, tmp_path, monkeypatch):
    base, published, held = str(tmp_path), [], []

    def publish(enriched, _):
        sent = logs.enriched_messages(logs.enriched_envelopes(enriched))
        short = F.when(F.col("arrival") % 10 == 3, F.substring("value", 1, 40)).otherwise(F.col("value"))
        logs.write_log(sent.withColumn("value", short), f"{base}/enriched")
        published.append(rows(sent, "arrival", "value"))

    def start(checkpoint):
        log = logs.read_folder(spark, f"{base}/enriched")
        storing.start_store(log, f"{base}/stored", f"{base}/unread", f"{base}/{checkpoint}", available_now=True).awaitTermination()

    def spied(*given, write=store.write_events):
        held.append(cached_frames(spark))
        write(*given)

    deliver(spark, base, clients(spark, range(60)))
    publishing(spark, base, publish)
    cut = {arrival: value[:40] for arrival, value in published[0] if arrival % 10 == 3}
    assert len(cut) == 6
    cached = cached_frames(spark)
    monkeypatch.setattr(logs, "PART", 10000)
    monkeypatch.setattr(store, "write_events", spied)
    for checkpoint in ("once", "again"):
        before = shuffle_files(spark)
        start(checkpoint)
        assert left_over(spark, before) == set()
        assert dict(rows(spark.read.parquet(f"{base}/unread"), "arrival", "value")) == cut
        kept = read_events(spark, f"{base}/events").filter(~F.col("event_id").isin([f"k-{i}" for i in cut]))
        got = read_events(spark, f"{base}/stored")
        assert got.count() == 54 and got.exceptAll(kept).count() == 0
        assert not Path(base, f"{checkpoint}-open").exists()
    assert set(held) == {cached} and len(held) >= 8  # no rows are cached while a part is written
