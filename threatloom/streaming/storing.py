"""The store stage as a stream: enriched envelopes in, each event appended once."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatloom.operators.parts import lay_out, split
from threatloom.operators.shape import to_stored
from threatloom.operators.store import append_parts
from threatloom.session import drop_dir, free_shuffles
from threatloom.streaming.logs import bad, good, parts, read_enriched


def start_store(
    enriched_messages: DataFrame,
    table: str,
    rejects: str,
    checkpoint: str,
    ids_keep_their_day: bool = False,
    available_now: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Append the events of an enriched log to the table at `table` until stopped, or once over what is there.

    Messages that cannot be read go to `rejects`, in a folder of their batch. A batch that is run
    again replaces that folder and appends nothing twice. While a batch is worked on, it lies parsed
    in a folder beside the checkpoint.
    """

    work = f"{checkpoint.rstrip('/')}-open"

    def handle(messages: DataFrame, batch_id: int) -> None:
        spark = messages.sparkSession
        free_shuffles(spark)
        try:
            # The text of a message that was read is in its payload.
            unread = read_enriched(messages).withColumn("value", F.when(F.col("payload").isNull(), F.col("value")))
            n = parts(messages)
            opened = lay_out(unread, work, F.col("payload.rawEvent.eventId"), n)
            refused = bad(opened).withColumn("batch", F.lit(batch_id).cast("bigint"))
            refused.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejects)
            append_parts([to_stored(good(part), "payload.") for part in split(opened, n)], table, ids_keep_their_day)
        finally:
            drop_dir(spark, work)

    writer = enriched_messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
