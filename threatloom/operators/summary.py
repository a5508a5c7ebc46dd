"""The whole summary in one pass over the (filtered) event table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.scalars import round1
from threatloom.operators.analytics import TOP_LIMIT

# grouping_id() of each grouping set: a bit per column that is not grouped
_SECTIONS = {0b0111: "category", 0b1011: "action", 0b1101: "attacker", 0b1110: "path", 0b1111: "total"}
_LISTS = [0b1101, 0b1110]


def summary(events: DataFrame, limit: int = TOP_LIMIT) -> DataFrame:
    """(section, key, event_count, average_threat_score) for the sections
    total, category, action, attacker and path.

    One scan feeds five groupings, added up on the map side. The two top lists are cut to
    their first rows in each task before those meet for the final ranking.
    """
    columns = [F.col(name) for name in ("category", "action", "client_ip", "path")]
    groups = events.groupingSets([[column] for column in columns] + [[]], *columns).agg(
        F.grouping_id().alias("grouping"),
        F.count(F.lit(1)).alias("event_count"),
        F.avg("threat_score").alias("average_threat_score"),
    )
    # Categories and actions are rank groups of their own, so the limit cuts only the lists.
    listed = F.col("grouping").isin(_LISTS)
    ranking = Window.partitionBy(
        "grouping", F.when(~listed, F.col("category")), F.when(~listed, F.col("action"))
    ).orderBy(F.desc("event_count"), F.asc_nulls_last("client_ip"), F.asc_nulls_last("path"))
    ranked = groups.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= limit)
    section, key = F.lit(None).cast("string"), F.coalesce("category", "action", "client_ip", "path")
    for grouping, name in _SECTIONS.items():
        section = F.when(F.col("grouping") == grouping, name).otherwise(section)
    named = ranked.select(section.alias("section"), key.alias("key"), "event_count", "average_threat_score")
    return named.filter(~F.col("section").isin("category", "action") | F.col("key").isNotNull())


def summary_document(sections: DataFrame) -> DataFrame:
    """One row: total, two maps and two ranked lists, averages rounded to one decimal.

    Input is the result of `summary`: a few dozen rows.
    """
    average = round1(F.col("average_threat_score"))

    def only(section: str, value: Column) -> Column:
        return F.collect_list(F.when(F.col("section") == section, value))

    def ranked(section: str, *fields: str) -> Column:
        rows = only(
            section,
            F.struct(
                (-F.col("event_count")).alias("order"),
                F.col("key").isNull().alias("last"),
                F.col("key"),
                F.col("event_count").alias("count"),
                average.alias("avgThreatScore"),
            ),
        )
        name, *rest = fields
        return F.transform(
            F.array_sort(rows), lambda r: F.struct(r["key"].alias(name), *[r[field].alias(field) for field in rest])
        )

    return sections.agg(
        F.coalesce(F.max(F.when(F.col("section") == "total", F.col("event_count"))), F.lit(0)).alias("totalEvents"),
        F.map_from_entries(
            only(
                "category",
                F.struct("key", F.struct(F.col("event_count").alias("count"), average.alias("avgThreatScore")).alias("v")),
            )
        ).alias("byCategory"),
        F.map_from_entries(only("action", F.struct("key", "event_count"))).alias("byAction"),
        ranked("attacker", "clientIp", "count", "avgThreatScore").alias("topAttackers"),
        ranked("path", "path", "count").alias("topTargetedPaths"),
    )
