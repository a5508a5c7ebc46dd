"""Read-side questions over the event table: filters, counts, top lists, buckets, pages."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.scalars import floor_div, instant
from threatloom.schema import INTERVAL_SECONDS

# --- Fixed values --------------------------------------------------------------
TOP_LIMIT = 10
DEFAULT_PAGE = 20
MAXIMUM_PAGE = 100
# -------------------------------------------------------------------------------

Instant = datetime | str | Column | None


def filter_events(
    events: DataFrame,
    config_id: int | None = None,
    start: Instant = None,
    end: Instant = None,
    category: str | None = None,
    action: str | None = None,
) -> DataFrame:
    """Conjunction of the given conditions; both time bounds are inclusive.

    A time bound also bounds `event_date`, which a filter on `timestamp` alone would not, so
    whole partition folders drop out before any file is opened.
    """
    dated = "event_date" in events.columns
    if config_id is not None:
        events = events.filter(F.col("config_id") == config_id)
    if start is not None:
        events = events.filter(F.col("timestamp") >= instant(start))
        if dated:
            events = events.filter(F.col("event_date") >= F.to_date(instant(start)))
    if end is not None:
        events = events.filter(F.col("timestamp") <= instant(end))
        if dated:
            events = events.filter(F.col("event_date") <= F.to_date(instant(end)))
    if category is not None:
        events = events.filter(F.col("category") == category)
    if action is not None:
        events = events.filter(F.col("action") == action)
    return events


def find_by_config(events: DataFrame, config_id: int) -> DataFrame:
    return filter_events(events, config_id=config_id)


def total_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"))


def _count() -> Column:
    return F.count(F.lit(1)).alias("event_count")


def _average_score() -> Column:
    return F.avg("threat_score").alias("average_threat_score")


def by_category(events: DataFrame) -> DataFrame:
    return events.filter("category IS NOT NULL").groupBy("category").agg(_count(), _average_score())


def by_action(events: DataFrame) -> DataFrame:
    return events.filter("action IS NOT NULL").groupBy("action").agg(_count())


def top_attackers(events: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    """Clients with the most events; equal counts order by address."""
    per_client = events.groupBy("client_ip").agg(_count(), _average_score())
    return per_client.orderBy(F.desc("event_count"), F.asc_nulls_last("client_ip")).limit(limit)


def top_paths(events: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    per_path = events.groupBy("path").agg(_count())
    return per_path.orderBy(F.desc("event_count"), F.asc_nulls_last("path")).limit(limit)


def bucket_width(interval: str) -> str:
    if interval not in INTERVAL_SECONDS:
        raise ValueError(f"invalid interval: {interval}; known are {', '.join(INTERVAL_SECONDS)}")
    return f"{INTERVAL_SECONDS[interval]} seconds"


def timeseries(events: DataFrame, interval: str = "1h") -> DataFrame:
    """Events per epoch-aligned bucket, empty buckets left out, in time order."""
    bucket = F.window("timestamp", bucket_width(interval))["start"].alias("bucket_start")
    return events.groupBy(bucket).agg(_count()).orderBy("bucket_start")


def count_category_within(events: DataFrame, category: str, start: Instant, end: Instant) -> DataFrame:
    """Events of one category in a closed window, over all configurations."""
    return filter_events(events, start=start, end=end, category=category).agg(_count())


def clamp_page(limit: int | None = None, offset: int | None = None) -> tuple[int, int]:
    rows = DEFAULT_PAGE if limit is None else max(1, min(MAXIMUM_PAGE, limit))
    return rows, max(0, offset or 0)


#: A page's hours with more events than this are told apart by second before anything is sorted.
SORTED_AT_ONCE = 100_000


def samples_page(events: DataFrame, limit: int | None = None, offset: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Newest events first, equal instants by id. Events without a timestamp are on no page.

    Whatever the offset, the hours that hold the page are found first, from `counts` (hour,
    event_count), rows that add up to these events such as `rollup.rolled` gives, or else from the
    events' timestamps. Only events of these hours, or of the page's seconds in them, are read
    whole and sorted.
    """
    rows, skip = clamp_page(limit, offset)
    if counts is None:
        hours = _per(events, 3600)
    else:
        hours = counts.groupBy(floor_div(F.unix_seconds("hour"), 3600).alias("bucket")).agg(F.sum("event_count").alias("event_count"))
    for width in (3600, 1):
        held = _covering(hours if width > 1 else _per(events, 1), skip, rows)
        if not held:
            return events.limit(0)
        (newest, newer, _), (oldest, _, _) = held[0], held[-1]
        start = F.timestamp_seconds(F.lit(oldest * width))
        events = filter_events(events, start=start, end=F.timestamp_micros(F.lit((newest + 1) * width * 1_000_000 - 1)))
        skip -= newer
        if sum(count for _, _, count in held) <= SORTED_AT_ONCE:
            break
    return events.orderBy(F.desc("timestamp"), F.asc("event_id")).offset(skip).limit(rows)


def _per(events: DataFrame, width: int) -> DataFrame:
    return events.groupBy(floor_div(F.unix_seconds("timestamp"), width).alias("bucket")).agg(_count())


def _covering(counts: DataFrame, skip: int, rows: int) -> list[tuple[int, int, int]]:
    """(bucket, events in newer ones, its events) of the buckets that hold events skip .. skip + rows, newest first.

    One row per hour of the table, or per second of the few hours of a page, comes to the driver.
    """
    held, newer = [], 0
    for bucket, count in sorted((tuple(row) for row in counts.filter("bucket IS NOT NULL").collect()), reverse=True):
        if newer + count > skip and newer < skip + rows:
            held.append((bucket, newer, count))
        newer += count
    return held


def samples_total(events: DataFrame) -> DataFrame:
    """The full match count beside a page, as a job of its own: no row has to move for it."""
    return events.agg(F.count(F.lit(1)).alias("total"))
