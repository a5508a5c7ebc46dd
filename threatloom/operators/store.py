"""The event table: append once per id, count, export."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatloom.operators import id_index
from threatloom.operators.parts import part_of
from threatloom.schema import EVENT_COLUMNS, EVENTS
from threatloom.sources.tables import read_events


def existing(spark: SparkSession, path: str) -> DataFrame:
    """The event table, empty where nothing has been written yet."""
    try:
        return read_events(spark, path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], EVENTS)


def new_events(batch: DataFrame, stored: DataFrame, order: tuple[str, ...] = ("received_at", "timestamp")) -> DataFrame:
    """Rows whose id is neither stored nor earlier in the batch: the first write wins.

    The stored ids are first cut down to those of the batch. Spark sizes both joins from the
    batch, so a micro-batch is broadcast to the id scan and the stored ids are not shuffled;
    a batch too large for that gets sort-merge joins on the id.
    """
    earliest = Window.partitionBy("event_id").orderBy(*order)
    once = batch.withColumn("_rank", F.row_number().over(earliest)).filter("_rank = 1").drop("_rank")
    known = stored.select("event_id").join(batch.select("event_id"), "event_id", "left_semi")
    return once.join(known, "event_id", "left_anti")


def append_once(batch: DataFrame, path: str, ids_keep_their_day: bool = False) -> None:
    """Append the batch's new events to the table at `path`. Repeating a batch changes nothing.

    Known ids are looked up in the table's id index (`id_index`), which the first such append
    builds and later ones keep, and in the days of the batch. The days are what makes a batch
    that failed between its events and its index entries find its own events when it is run
    again; it then enters what is missing. With `ids_keep_their_day`, which states that one id
    always carries the same timestamp, the days alone are searched; ids are entered only where
    the table has an index. One writer at a time is assumed, and a failed batch to be the next.
    """
    own = not batch.is_cached
    dated = _dated(batch)
    if own:
        dated = dated.persist()
    try:
        append_parts([dated], path, ids_keep_their_day)
    finally:
        if own:
            dated.unpersist()


def _dated(batch: DataFrame) -> DataFrame:
    return batch.select(*EVENT_COLUMNS, F.to_date("timestamp").alias("event_date"))


def append_parts(batch: list[DataFrame], path: str, ids_keep_their_day: bool = False) -> None:
    """`append_once` for a batch in parts as `parts.part_of` deals them, one after the other; each part is read several times.

    A part meets the stored ids that fall in it and no others.
    """
    spark = batch[0].sparkSession
    stored = existing(spark, path)
    generation = id_index.newest(spark, path)
    if generation is None and not ids_keep_their_day:
        generation = id_index.rebuild(stored.select("event_id").filter("event_id IS NOT NULL"), path)
    for k, dated in enumerate(map(_dated, batch)):
        mine = stored if len(batch) == 1 else stored.filter(part_of(F.col("event_id"), len(batch)) == k)
        # Spark prunes the table's folders by the days it finds here, however many there are.
        known = mine.join(dated.select("event_date").distinct(), "event_date", "left_semi").select("event_id")
        ids = dated.select("event_id").filter("event_id IS NOT NULL")
        if ids_keep_their_day:
            write_events(new_events(dated, known), path)
            entries = ids.distinct()
        else:
            indexed = id_index.held(spark, path, generation, ids)
            write_events(new_events(dated, known.unionByName(indexed)), path)
            entries = ids.distinct().join(indexed, "event_id", "left_anti")
        if generation is not None:
            id_index.add(entries, path, generation)


def write_events(events: DataFrame, path: str) -> None:
    """Append rows, one folder per day, files sorted for filters on configuration and time.

    Rebalancing lets AQE split a day that holds most rows and merge small ones, so neither a
    huge task nor a swarm of tiny files comes out.
    """
    laid_out = events.hint("rebalance", "event_date").sortWithinPartitions("event_date", "config_id", "timestamp")
    laid_out.write.mode("append").partitionBy("event_date").parquet(path)


def count_all(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("stored_events"))


def export_json(events: DataFrame, path: str) -> None:
    """One JSON document per line, in as many files as there are partitions."""
    events.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
