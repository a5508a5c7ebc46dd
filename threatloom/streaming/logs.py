"""Message logs between the stages: Kafka topics, or folders of files with the same columns."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.operators.id_index import BUCKETS
from threatloom.schema import ENRICHED_ENVELOPE, MESSAGE, RAW_ENVELOPE

CORRELATION_HEADER = "x-correlation-id"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic from its earliest offset, as (key, value, correlation, arrival).

    `maxOffsetsPerTrigger` bounds a micro-batch. Needs the Kafka connector on the class path.
    """
    stream = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("includeHeaders", "true")
        .option("maxOffsetsPerTrigger", "5000000")
        .options(**options)
        .load()
    )
    return kafka_messages(stream)


#: More partitions than a topic may have; part of every position, so it stays as it is for a topic's life.
PARTITIONS = 64


def kafka_messages(records: DataFrame, partitions: int = PARTITIONS) -> DataFrame:
    """Kafka's columns to a message; the last header of a name counts.

    `arrival` is offset * partitions + partition: no two records share one, and it rises within a
    partition, so per client where the topic is keyed by client. A partition number that does not
    fit fails the query.
    """
    fits = F.col("partition") < partitions
    position = F.when(fits, F.col("offset") * partitions + F.col("partition")).otherwise(
        F.raise_error(F.lit(f"partition number of {partitions} or more"))
    )
    named = F.filter("headers", lambda header: header["key"] == CORRELATION_HEADER)
    return records.select(
        F.col("key").cast("string"),
        F.col("value").cast("string"),
        F.try_element_at(named, F.lit(-1))["value"].cast("string").alias("correlation"),
        position.cast("bigint").alias("arrival"),
    )


def read_folder(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same log kept as Parquet files in a folder."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _text(messages: DataFrame) -> int:
    return messages.agg(F.sum(F.octet_length("value").cast("bigint"))).first()[0] or 0


#: About as many bytes of message text in a part of a batch.
PART = 1 << 30


def parts(messages: DataFrame) -> int:
    """How many parts (`operators.parts`) a batch makes by its amount of text: 1, 2, 4, ... Costs one more read of the source."""
    needed = -(-_text(messages) // PART)
    return min(BUCKETS, 1 << max(0, needed - 1).bit_length())


#: Bytes of message text that one task keeps. Parsed rows take a few times as much.
PORTION = 1 << 25


def portions(messages: DataFrame) -> DataFrame:
    """The messages of a batch dealt evenly to tasks by their amount of text, for stages that keep them parsed.

    A part of a file or of a topic may be small as stored and many times that as text, and the
    parts get larger with the batch. Costs one more read of the source and one shuffle; a batch
    that one task may hold stays as it is.
    """
    parts = -(-_text(messages) // PORTION)
    if parts <= 1:
        return messages
    return messages.repartition(max(parts, messages.sparkSession.sparkContext.defaultParallelism))


def _message(envelope: list[str], key: Column) -> list[Column]:
    return [
        key.alias("key"),
        F.to_json(F.struct(*envelope), _JSON).alias("value"),
        F.col("correlationId").alias("correlation"),
        F.col("arrival"),
    ]


_ENVELOPE = ["correlationId", "occurredAt", "version", "payload"]


def raw_messages(envelopes: DataFrame) -> DataFrame:
    """Raw envelopes keyed by client address."""
    return envelopes.select(_message(_ENVELOPE, F.col("payload.clientIp")))


def enriched_envelopes(enriched: DataFrame) -> DataFrame:
    """Envelopes of scored events, with the correlation id and instant of the raw message they came in."""
    return enriched.select(
        "arrival",
        "correlationId",
        "occurredAt",
        F.lit(1).alias("version"),
        F.struct("rawEvent", "attackType", "threatScore", "receivedAt").alias("payload"),
    )


def enriched_messages(envelopes: DataFrame) -> DataFrame:
    """Enriched envelopes keyed by configuration id, as text."""
    return envelopes.select(_message(_ENVELOPE, F.col("payload.rawEvent.configId").cast("string")))


def read_raw(messages: DataFrame, *kept: str) -> DataFrame:
    """(arrival, correlationId, occurredAt, version, payload) and the columns `kept`; `payload` is null for bad messages."""
    return _open(messages, RAW_ENVELOPE, *kept)


def read_enriched(messages: DataFrame) -> DataFrame:
    return _open(messages, ENRICHED_ENVELOPE)


def _open(messages: DataFrame, schema, *kept: str) -> DataFrame:
    """Unknown fields are ignored; the text is kept so that bad messages can be set aside."""
    return messages.withColumn("envelope", F.from_json("value", schema)).select("arrival", "value", *kept, "envelope.*")


def good(opened: DataFrame) -> DataFrame:
    return opened.filter(F.col("payload").isNotNull()).drop("value")


def bad(opened: DataFrame) -> DataFrame:
    return opened.filter(F.col("payload").isNull()).select("arrival", "value")


def write_log(messages: DataFrame, path: str) -> None:
    messages.select(*MESSAGE.names).write.mode("append").option("compression", "zstd").parquet(path)


def _records(messages: DataFrame) -> DataFrame:
    header = F.struct(F.lit(CORRELATION_HEADER).alias("key"), F.col("correlation").cast("binary").alias("value"))
    return messages.select("key", "value", F.array(header).alias("headers"))


def send_kafka(messages: DataFrame, servers: str, topic: str, **options: str) -> None:
    """Send one batch of messages to a topic, as the `publish` hook of the write path may. A repeated batch sends again."""
    kafka = _records(messages).write.format("kafka").option("kafka.bootstrap.servers", servers)
    kafka.option("topic", topic).option("includeHeaders", "true").options(**options).save()


def publish_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str, **options: str):
    """Stream messages to a topic, the correlation id as a header."""
    return (
        _records(messages)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("includeHeaders", "true")
        .option("checkpointLocation", checkpoint)
        .options(**options)
        .start()
    )
