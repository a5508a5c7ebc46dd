"""Hourly counts kept beside an event table, so that questions about long ranges read no events.

A row is (event file, configuration, hour, category, action) with its number of events and the
sum and number of their scores. The event file is what ties both together: `rolled` takes the
rows of files that the table has, and counts files without rows on the spot. An answer is
therefore exact whether `refresh` ran after the last append, long before, or never, and a
refresh that fails half-way or runs again does no harm: a file's rows are written in one piece.
The names of the table's files are compared on the driver, where Spark lists them anyhow.

The rows lie in `_rollup` below the table, a name that readers of the table pass over.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.scalars import instant
from threatloom.operators.analytics import Instant, bucket_width, filter_events
from threatloom.schema import EVENTS, INTERVAL_SECONDS
from threatloom.sources.tables import read_events

KEYS = ["config_id", "hour", "category", "action"]
_ROLLUP = "file string, config_id int, hour timestamp, category string, action string, event_count long, score_sum long, scored long"


def _moved(at: Column, micros: int) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + F.lit(micros))


def hourly(events: DataFrame, *further: str) -> DataFrame:
    """Events counted per configuration, hour, category and action; added up on the map side."""
    keyed = events.withColumn("hour", F.date_trunc("hour", "timestamp"))
    return keyed.groupBy(*further, *KEYS).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum("threat_score").cast("long").alias("score_sum"),
        F.count("threat_score").alias("scored"),
    )


def _own_name(path: Column) -> Column:
    """A file by its day's folder and its name, however the table's path is written."""
    return F.substring_index(path, "/", -2)


def _listed(spark: SparkSession, path: str) -> dict[str, str]:
    return {"/".join(file.rsplit("/", 2)[-2:]): file for file in read_events(spark, path).inputFiles()}


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_ROLLUP).parquet(f"{path}/_rollup")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _ROLLUP)


def _opened(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    return spark.read.schema(EVENTS).option("basePath", path).parquet(*files)


def _names(rows: DataFrame) -> set[str]:
    return {row[0] for row in rows.select("file").distinct().collect()}


def refresh(spark: SparkSession, path: str) -> int:
    """Count the files that have no rows yet; how many these were. One writer at a time is assumed."""
    known = _names(_stored(spark, path))
    missing = [file for name, file in _listed(spark, path).items() if name not in known]
    if missing:
        named = _opened(spark, path, missing).withColumn("file", _own_name(F.col("_metadata.file_path")))
        # All rows of an event file go to one file here, which is there as a whole or not at all.
        hourly(named, "file").repartition("file").write.mode("append").parquet(f"{path}/_rollup")
    return len(missing)


def rolled(
    spark: SparkSession,
    path: str,
    config_id: int | None = None,
    start: Instant = None,
    end: Instant = None,
    category: str | None = None,
    action: str | None = None,
) -> DataFrame:
    """Rows (KEYS, event_count, score_sum, scored) that add up to the stored events which pass the conditions.

    Both bounds are inclusive, as in `filter_events`. Whole hours between them come from the
    rollup, the rest of the first and last hour from the events, of which only those days are
    opened. Keys may occur more than once.
    """
    listed, rows = _listed(spark, path), _stored(spark, path)
    known = _names(rows)
    gone = [(name,) for name in known - listed.keys()]
    if gone:
        rows = rows.join(spark.createDataFrame(gone, "file string"), "file", "left_anti")
    conditions = {"config_id": config_id, "category": category, "action": action}
    inner = filter_events(rows.drop("file"), **conditions)
    first, behind = F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")
    if start is not None:
        first = F.date_trunc("hour", _moved(instant(start), 3_600_000_000 - 1))
        inner = inner.filter(F.col("hour") >= first)
    if end is not None:
        behind = F.date_trunc("hour", _moved(instant(end), 1))
        inner = inner.filter(F.col("hour") < behind)
    parts = [inner]
    covered = [file for name, file in listed.items() if name in known]
    missing = [file for name, file in listed.items() if name not in known]
    if covered:
        events = _opened(spark, path, covered)
        if start is not None:
            until = _moved(first, -1) if end is None else F.least(_moved(first, -1), instant(end))
            parts.append(hourly(filter_events(events, start=start, end=until, **conditions)))
        if end is not None:
            since = behind if start is None else F.greatest(behind, first)
            parts.append(hourly(filter_events(events, start=since, end=end, **conditions)))
    if missing:
        parts.append(hourly(filter_events(_opened(spark, path, missing), start=start, end=end, **conditions)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def per_hour(rows: DataFrame) -> DataFrame:
    """(hour, event_count), a row per hour in one partition: what a service keeps (`persist`) to page from until the next append."""
    return rows.groupBy("hour").agg(F.sum("event_count").alias("event_count")).coalesce(1)


def total(rows: DataFrame, name: str = "total") -> DataFrame:
    return rows.agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias(name))


def by_category(rows: DataFrame) -> DataFrame:
    """`analytics.by_category` from hourly rows."""
    average = F.try_divide(F.sum("score_sum"), F.sum("scored")).alias("average_threat_score")
    return rows.filter("category IS NOT NULL").groupBy("category").agg(F.sum("event_count").alias("event_count"), average)


def by_action(rows: DataFrame) -> DataFrame:
    """`analytics.by_action` from hourly rows."""
    return rows.filter("action IS NOT NULL").groupBy("action").agg(F.sum("event_count").alias("event_count"))


def timeseries(rows: DataFrame, interval: str = "1h") -> DataFrame:
    """`analytics.timeseries` from hourly rows; intervals below an hour need the events."""
    width = bucket_width(interval)
    if INTERVAL_SECONDS[interval] % 3600:
        raise ValueError(f"hourly rows do not tell intervals of {interval}")
    bucket = F.window("hour", width)["start"].alias("bucket_start")
    return rows.groupBy(bucket).agg(F.sum("event_count").alias("event_count")).orderBy("bucket_start")
