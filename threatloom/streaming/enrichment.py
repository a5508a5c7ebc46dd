"""The write path as a stream: raw envelopes in, scored events appended once each.

Each micro-batch runs the batch operators. What must outlive a batch — which ids were seen
in the last hour and when each client was seen in the last ten minutes — is a log of
*sightings*, (event id, client, instant, arrival), in folders by hour and batch:

* a client that sends most of the traffic is spread by `offender_count` like in batch;
* old entries leave by not being read: only folders of hours that can matter are opened;
* a batch that spans many hours, as a replay does, puts several hours in a folder, so its
  folders and files are few however long the time it covers;
* ids and clients are judged on sightings alone; whole events lie in files beside the checkpoint
  while their batch is worked on, and are joined to what was found in parts (`operators.parts`);
* a batch that is run again after a failure replaces its own folders and reads only those of
  earlier batches, so the outcome is the same;
* rules are read again for each batch, so an edit applies from the next batch on.
"""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from threatloom.functions.scalars import floor_div
from threatloom.operators.enrich import client_ip, event_id, score_events, sightings
from threatloom.operators.parts import PART, lay_out, lay_out_parts, split
from threatloom.operators.shape import to_stored
from threatloom.operators.store import append_parts
from threatloom.operators.windows import STRETCH, first_sight, offender_count
from threatloom.schema import DEDUP_RETENTION_SECONDS, OFFENDER_WINDOW_SECONDS
from threatloom.session import drop_dir, free_shuffles
from threatloom.streaming.logs import bad, good, parts, read_raw

_SIGHTINGS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("client", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("arrival", T.LongType()),
        T.StructField("hour", T.LongType()),
        T.StructField("batch", T.LongType()),
    ]
)
#: The columns of a sighting itself.
_SEEN = ["event_id", "client", "received_at", "arrival"]


TRIGGERED_AT = "triggered_at"


def received(messages: DataFrame) -> DataFrame:
    """(arrival, received_at, rawEvent, correlationId, occurredAt) of readable raw messages.

    The receipt time is the trigger's clock, which a retried batch sees again unchanged; the
    stream puts it beside each message.
    """
    return good(read_raw(messages, TRIGGERED_AT)).select(
        "arrival",
        F.col(TRIGGERED_AT).alias("received_at"),
        F.col("payload").alias("rawEvent"),
        "correlationId",
        "occurredAt",
    )


_HOUR = 3_600_000_000

#: About as many folders a batch has at most; one that spans fewer hours has a folder for each.
_FOLDERS = 64
#: `hour` is a folder's first hour plus this for each further hour it holds; no instant's hour is as far as half of it from 0.
_FURTHER = 1 << 33


def further_hours(first_hour: int, last_hour: int) -> int:
    """Hours that a folder of a batch holds beyond its first: 0, or as many as make 2, 4, 8, ... hours."""
    return (1 << ((last_hour - first_hour) // _FOLDERS).bit_length()) - 1


def earlier_sightings(spark: SparkSession, path: str, batch_id: int, first_hour: int, last_hour: int) -> DataFrame:
    """What earlier batches saw in the given hours; the filter on `hour` leaves out folders of other hours."""
    try:
        log = spark.read.schema(_SIGHTINGS).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _SIGHTINGS)
    further = floor_div(F.col("hour") + _FURTHER // 2, _FURTHER)
    first = F.col("hour") - further * _FURTHER
    near = log.filter((first <= last_hour) & (first + further >= first_hour) & (F.col("batch") < batch_id))
    return near.filter(floor_div(F.unix_micros("received_at"), _HOUR).between(first_hour, last_hour))


_RETENTION = DEDUP_RETENTION_SECONDS * 1_000_000


def _sights(instants: Column) -> Column:
    """Of an id's instants in order, those at which it is new: each at least the retention time after the last such."""

    def take(taken: Column, at: Column) -> Column:
        new = F.coalesce(at >= F.try_element_at(taken, F.lit(-1)) + _RETENTION, F.lit(True))
        return F.when(new, F.array_append(taken, at)).otherwise(taken)

    return F.aggregate(instants, F.array().cast("array<bigint>"), take)


def first_sights(batch: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows at which their id is new: never seen, or last counted as new the retention time ago or longer.

    The same holds inside a batch and across batches, so a replay gives one result however it is
    cut. Of copies at one instant the first in the log stays. Rows without id drop out. What is
    gathered per id is its distinct receipt times in this batch: one where the trigger's clock is
    the receipt time, and at most the rows of a batch, which the source's rate limit bounds.
    """
    micros = F.unix_micros("received_at")
    known = earlier.select(F.col("event_id").alias("_id"), F.unix_micros("received_at").alias("_seen"))
    still_known = F.col("_seen") + _RETENTION > micros
    unseen = batch.join(known, (event_id() == F.col("_id")) & still_known, "left_anti")
    instants = unseen.groupBy(event_id().alias("_id")).agg(F.array_sort(F.collect_set(micros)).alias("_all"))
    new = instants.select("_id", F.explode(_sights(F.col("_all"))).alias("_at"))
    copies = first_sight(unseen, F.struct(event_id().alias("id"), micros.alias("at")))
    return copies.join(new, (event_id() == F.col("_id")) & (micros == F.col("_at")), "left_semi")


def record_sightings(fresh: DataFrame, batch_id: int, path: str, further: int = 0) -> None:
    """Write the batch's own folders, replacing those of a failed attempt.

    `further` comes from `further_hours`. The rows of a folder are brought together first, or each
    task would write a file to every folder; AQE splits a folder that holds most rows.
    """
    width = further + 1
    first = floor_div(F.unix_micros("received_at"), _HOUR * width) * width
    rows = sightings(fresh).withColumns({"hour": first + further * _FURTHER, "batch": F.lit(batch_id).cast("bigint")})
    laid_out = rows.hint("rebalance", "hour").sortWithinPartitions("hour", "received_at")
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(path)


def own_sightings(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What `record_sightings` wrote for a batch."""
    return spark.read.schema(_SIGHTINGS).parquet(path).filter(F.col("batch") == batch_id).select(*_SEEN)


def count_batch(fresh: DataFrame, earlier: DataFrame, since: int, stretch: int = STRETCH) -> DataFrame:
    """Sightings of a batch with their count; earlier ones take part in it and then drop out again.

    `since` is the oldest receipt time of the batch in microseconds.
    """
    recent = earlier.filter(F.unix_micros("received_at") >= since - OFFENDER_WINDOW_SECONDS * 1_000_000)
    together = fresh.withColumn("new", F.lit(True)).unionByName(recent.select(*_SEEN), allowMissingColumns=True)
    counted = offender_count(together, F.col("client"), F.col("received_at"), stretch=stretch)
    return counted.filter("new").select(*_SEEN, "offenderEventCount")


def attach_to_first(raw: DataFrame, counted: DataFrame) -> DataFrame:
    """Bring offenderEventCount to the event of each counted sighting; other copies drop out.

    Copies of an id differ in their receipt time or log position, so those of a hot id spread over
    tasks; of rows that agree in all of it one stays. Whole events are shuffled once.
    """
    names = ["_id", "_client", "_nameless", "_at", "_arrival"]

    def keys(id: Column, client: Column) -> list[Column]:
        values = [id, F.coalesce(client, F.lit("")), client.isNull(), F.col("received_at"), F.col("arrival")]
        return [value.alias(name) for value, name in zip(values, names)]

    keyed = raw.select(*keys(event_id(), client_ip()), *raw.columns)
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("_arrival"))
    once = keyed.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    found = counted.select(*keys(F.col("event_id"), F.col("client")), "offenderEventCount")
    return once.join(found, names).drop(*names)


def spacing(first: int, last: int, rows: int) -> int:
    """Log positions for each message of a batch, on average."""
    return max(1, (last - first + 1) // max(1, rows))


def start_enrichment(
    raw_messages: DataFrame,
    table: str,
    sightings_path: str,
    checkpoint: str,
    rules: Callable[[], DataFrame],
    receive: Callable[[DataFrame], DataFrame] = received,
    ids_keep_their_day: bool = False,
    rejects_path: str | None = None,
    publish: Callable[[DataFrame, int], None] | None = None,
    stretch: int | None = None,
    available_now: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Run the write path until stopped, or once over everything available.

    `ids_keep_their_day` goes to `append_once`: set it where an id never changes its timestamp,
    so that a batch searches its own days for known ids and not the whole table.
    Messages that cannot be read are written to `rejects_path`, by default `rejects` beside the
    sightings, in a folder of their batch. `rules` is called for each batch. `publish` may forward a batch's enriched rows as well;
    it gets all of them at once, and must be done with them when it returns: they lie in a folder
    beside the checkpoint that goes then.
    `stretch` is explained at `enrich`; left out, each batch takes one that spans as many of its
    messages whatever gaps its log positions have, as those behind `start_ingest` do.
    """

    work = f"{checkpoint.rstrip('/')}-open"
    rejects = rejects_path or f"{sightings_path.rstrip('/')}-rejects"

    def handle(messages: DataFrame, batch_id: int) -> None:
        spark = messages.sparkSession
        free_shuffles(spark)
        refused = bad(read_raw(messages)).withColumn("batch", F.lit(batch_id).cast("bigint"))
        refused.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejects)
        try:
            work_through(spark, messages, batch_id)
        finally:
            drop_dir(spark, work)

    def work_through(spark: SparkSession, messages: DataFrame, batch_id: int) -> None:
        n = parts(messages)
        batch = lay_out(receive(messages), f"{work}/received", event_id(), n)
        at = F.unix_micros("received_at")
        bounds = batch.agg(F.min(at), F.max(at), F.min("arrival"), F.max("arrival"), F.count(F.lit(1))).first()
        if bounds[0] is None:
            return
        first_hour, last_hour = bounds[0] // _HOUR, bounds[1] // _HOUR
        earlier = earlier_sightings(spark, sightings_path, batch_id, first_hour - 1, last_hour)
        narrow = F.struct(event_id().alias("eventId"), client_ip().alias("clientIp")).alias("rawEvent")
        fresh = first_sights(batch.select(narrow, "received_at", "arrival"), earlier)
        record_sightings(fresh, batch_id, sightings_path, further_hours(first_hour, last_hour))
        fresh = own_sightings(spark, sightings_path, batch_id)
        counted = count_batch(fresh, earlier, bounds[0], stretch or STRETCH * spacing(*bounds[2:]))
        counted = lay_out(counted, f"{work}/counted", F.col("event_id"), n)
        pairs = zip(split(batch, n), split(counted, n))
        whole = lay_out_parts([attach_to_first(*pair) for pair in pairs], f"{work}/whole")
        drop_dir(spark, f"{work}/received")
        enriched = score_events(whole, rules())
        append_parts([to_stored(part) for part in split(enriched, n)], table, ids_keep_their_day)
        if publish is not None:
            publish(enriched.drop(PART), batch_id)

    stamped = raw_messages.withColumn(TRIGGERED_AT, F.current_timestamp())
    writer = stamped.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()
