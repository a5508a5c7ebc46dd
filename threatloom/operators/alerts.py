"""Threshold alerts: all rules answered by one pass over the recent events."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.functions.scalars import floor_div, instant, is_blank
from threatloom.operators.analytics import filter_events
from threatloom.operators.rule_table import violations
from threatloom.schema import ALERT_RULE, CATEGORIES

_MINUTE = 60_000_000


def validate_alert_rules(rules: DataFrame) -> DataFrame:
    """Add `violations`: empty for a usable rule."""

    def below_one(column: str):
        return F.col(column).isNull() | (F.col(column) < 1)

    unknown = F.col("category").isNull() | ~F.col("category").isin(CATEGORIES)
    return rules.withColumn(
        "violations",
        violations(
            # Messages that callers match on.
            (is_blank(F.col("id")), "id", "must not be blank"),
            (unknown, "category", "invalid category"),
            (below_one("threshold"), "threshold", "must be at least 1"),
            (below_one("window_minutes"), "windowMinutes", "must be at least 1"),
        ),
    )


def evaluate_alerts(events: DataFrame, rules: DataFrame, as_of: datetime | str | None = None) -> DataFrame:
    """Per rule: events of its category in [as_of - minutes, as_of], and whether it fires.

    Events never meet rules one by one. They are first counted per category and age in whole
    minutes (rounded up, so a window of m minutes is exactly ages 0..m); the rules are then
    placed among these few counts and read off a running total.
    """
    as_of = datetime.now(timezone.utc) if as_of is None else as_of
    moment = instant(as_of)
    horizon = rules.agg(F.max("window_minutes")).first()[0] or 0
    recent = filter_events(events, start=moment - F.make_dt_interval(mins=F.lit(horizon)), end=moment)
    age = floor_div(F.unix_micros(moment) - F.unix_micros("timestamp") + (_MINUTE - 1), _MINUTE)
    counts = recent.groupBy("category", age.alias("_minutes")).agg(F.count(F.lit(1)).alias("_n"))
    rule_columns = [F.col(name) for name in ALERT_RULE.names]
    no_rule = [F.lit(None).cast(f.dataType).alias(f.name) for f in ALERT_RULE.fields if f.name != "category"]
    line = counts.select(*no_rule, "category", "_minutes", "_n", F.lit(0).alias("_rule")).unionByName(
        rules.select(*rule_columns, F.col("window_minutes").cast("bigint").alias("_minutes"),
                     F.lit(0).cast("bigint").alias("_n"), F.lit(1).alias("_rule"))
    )
    running = Window.partitionBy("category").orderBy("_minutes", "_rule").rowsBetween(Window.unboundedPreceding, 0)
    placed = line.withColumn("event_count", F.sum("_n").over(running)).filter("_rule = 1")
    return placed.select(
        F.col("id").alias("rule_id"),
        "category",
        "threshold",
        "window_minutes",
        "event_count",
        (F.col("event_count") >= F.col("threshold")).alias("firing"),
        (moment - F.make_dt_interval(mins=F.col("window_minutes"))).alias("window_from"),
        moment.alias("window_to"),
    )
