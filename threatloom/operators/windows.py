"""First sight of an id, and the rolling count of events per client.

A client under watch is by nature a hot key, and a batch clock can give all its events one
instant, so neither the client nor (client, instant) is a safe unit of work. The rolling
count therefore never ranks a client's events together:

* events are counted per *point* = (client, instant, stretch of the log) before any shuffle;
* points, not events, are ordered, in cells of a fraction of the window;
* an event adds its own rank inside its point, which holds at most `STRETCH` log positions.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.scalars import floor_div
from threatloom.schema import OFFENDER_WINDOW_SECONDS

STRETCH = 1 << 20  # log positions per point
CELLS_PER_WINDOW = 4


def first_sight(events: DataFrame, event_id: Column, arrival: str = "arrival") -> DataFrame:
    """The earliest copy of each id.

    Filtering on rank 1 lets Spark keep one row per id on the map side (WindowGroupLimit), so
    many copies of one id do not meet in one task.
    """
    ranked = Window.partitionBy(event_id).orderBy(arrival)
    return events.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def _points(events: DataFrame, key: Column, micros: Column, stretch: Column) -> DataFrame:
    return events.groupBy(key.alias("_key"), micros.alias("_at"), stretch.alias("_stretch")).agg(
        F.count(F.lit(1)).alias("_n")
    )


def _earlier_in_window(points: DataFrame, span: int, cells: int) -> DataFrame:
    """For each point, the events of all earlier points no older than `span` microseconds.

    Time is cut into cells of span/cells. What precedes a point is then
      the earlier points of its own cell
      + the totals of the `cells` cells before it
      - the points of the oldest of those that have left the window,
    which all meet in the partition (key, cell) of the point. Points of the oldest cell are
    shifted forward by exactly `span`, so the bound is exact to the microsecond.
    """
    width = span // cells
    cell = floor_div(F.col("_at"), width)
    own_and_expiring = points.select(
        "_key",
        F.inline(
            F.array(
                F.struct(cell.alias("_cell"), F.col("_at"), F.lit(1).alias("_kind")),
                F.struct((cell + cells).alias("_cell"), (F.col("_at") + span).alias("_at"), F.lit(2).alias("_kind")),
            )
        ),
        "_stretch",
        "_n",
    )
    totals = points.groupBy("_key", cell.alias("_from")).agg(F.sum("_n").alias("_n"))
    cells_before = totals.select(
        "_key",
        F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + cells)).alias("_cell"),
        F.lit(None).cast("bigint").alias("_at"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast("bigint").alias("_stretch"),
        "_n",
    )
    # Totals have no instant and sort first. At equal instants own points come before expiring
    # ones: an event exactly one window old has not left yet.
    so_far = Window.partitionBy("_key", "_cell").orderBy("_at", "_kind", "_stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    signed = F.when(F.col("_kind") == 2, -F.col("_n")).otherwise(F.col("_n"))
    counted = own_and_expiring.unionByName(cells_before).withColumn(
        "_before", F.coalesce(F.sum(signed).over(so_far), F.lit(0))
    )
    return counted.filter("_kind = 1").select("_key", "_at", "_stretch", "_before")


def offender_count(
    events: DataFrame,
    client: Column,
    received_at: Column,
    arrival: str = "arrival",
    window_seconds: int = OFFENDER_WINDOW_SECONDS,
    collapse_millis: bool = False,
    cells: int = CELLS_PER_WINDOW,
    stretch: int = STRETCH,
    out: str = "offenderEventCount",
) -> DataFrame:
    """Events of the same client in the closed window that ends at this event, itself included.

    Events of one instant count in log order: the first of six sees 1, the last sees 6.
    With `collapse_millis`, all events of one client in one millisecond count as one.
    """
    client = F.coalesce(client, F.lit(""))  # a join key must not be null
    micros = F.unix_micros(received_at)
    span = window_seconds * 1_000_000
    if collapse_millis:
        millis = floor_div(micros, 1000) * 1000
        keyed = events.withColumns({"_key": client, "_at": millis, "_stretch": F.lit(0).cast("bigint")})
        distinct = keyed.select("_key", "_at", "_stretch").distinct().withColumn("_n", F.lit(1).cast("bigint"))
        before = _earlier_in_window(distinct, span, cells)
        # A hot (client, millisecond) must not meet in one task: log stretches spread it, and
        # the few rows of `before` are repeated once per stretch.
        spread = keyed.withColumn("_part", floor_div(F.col(arrival), stretch))
        parts = spread.select("_key", "_at", "_part").distinct()
        per_part = parts.join(before, ["_key", "_at"]).select("_key", "_at", "_part", "_before")
        joined = spread.join(per_part, ["_key", "_at", "_part"])
        return joined.withColumn(out, F.col("_before") + 1).drop("_key", "_at", "_stretch", "_part", "_before")

    keyed = events.withColumns({"_key": client, "_at": micros, "_stretch": floor_div(F.col(arrival), stretch)})
    points = _points(keyed, F.col("_key"), F.col("_at"), F.col("_stretch"))
    before = _earlier_in_window(points, span, cells)
    rank = F.row_number().over(Window.partitionBy("_key", "_at", "_stretch").orderBy(arrival))
    ranked = keyed.withColumn("_rank", rank)
    counted = ranked.join(before, ["_key", "_at", "_stretch"]).withColumn(out, F.col("_before") + F.col("_rank"))
    return counted.drop("_key", "_at", "_stretch", "_rank", "_before")
