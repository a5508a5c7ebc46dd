"""The first stage as a stream: ingest messages in, raw envelopes and rejects out."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatloom.operators.ingest import accepted, check_messages, rejected
from threatloom.streaming.logs import portions, raw_messages


def raw_stream(messages: DataFrame) -> DataFrame:
    """Messages of the raw log, ready for `logs.publish_kafka`; no state, no shuffle."""
    return raw_messages(accepted(check_messages(messages), blank_correlation_counts=True))


def start_ingest(
    messages: DataFrame, raw_path: str, rejects_path: str, checkpoint: str, available_now: bool = False, interval: str = "10 seconds"
) -> StreamingQuery:
    """Write accepted events to a raw log and refused messages, with the reason, to a table.

    Each batch owns a folder in both, which a second attempt replaces.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = check_messages(portions(batch)).persist()
        try:
            outputs = {
                raw_path: raw_messages(accepted(checked, blank_correlation_counts=True)),
                rejects_path: rejected(checked),
            }
            for path, rows in outputs.items():
                owned = rows.withColumn("batch", F.lit(batch_id).cast("bigint"))
                owned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        finally:
            checked.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
