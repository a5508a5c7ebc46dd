"""Questions kept up to date while the stream runs."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatloom.operators.alerts import evaluate_alerts
from threatloom.operators.analytics import bucket_width
from threatloom.operators.store import existing

def live_timeseries(events: DataFrame, interval: str = "1h", lateness: str | None = None) -> DataFrame:
    """Running (bucket_start, event_count), for update mode.

    State is one counter per bucket, so by default none is ever closed and late events count
    like all others; with `lateness`, buckets older than that are dropped from state.
    """
    if lateness is not None:
        events = events.withWatermark("timestamp", lateness)
    counts = events.groupBy(F.window("timestamp", bucket_width(interval))).agg(F.count(F.lit(1)).alias("event_count"))
    return counts.select(F.col("window.start").alias("bucket_start"), "event_count")


def start_timeseries(events: DataFrame, path: str, checkpoint: str, interval: str = "1h", **trigger) -> StreamingQuery:
    """Write each batch's changed buckets; `read_timeseries` keeps the latest of each."""

    def handle(changed: DataFrame, batch_id: int) -> None:
        row = changed.withColumn("batch", F.lit(batch_id).cast("bigint"))
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    stream = live_timeseries(events, interval).writeStream.outputMode("update").foreachBatch(handle)
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def read_timeseries(spark: SparkSession, path: str) -> DataFrame:
    """A bucket's count only ever grows, so its largest value is its latest."""
    changes = spark.read.schema("bucket_start timestamp, event_count long, batch long").parquet(path)
    return changes.groupBy("bucket_start").agg(F.max("event_count").alias("event_count"))


def alerts_after_batch(
    table: str,
    rules: Callable[[], DataFrame],
    report: Callable[[DataFrame, int], None],
    clock: Callable[[], datetime | str | None] = lambda: None,
) -> Callable[[DataFrame, int], None]:
    """A `publish` hook for the write path: evaluate all alert rules after each batch is stored."""

    def publish(enriched: DataFrame, batch_id: int) -> None:
        spark = enriched.sparkSession
        report(evaluate_alerts(existing(spark, table), rules(), clock()), batch_id)

    return publish
