"""Readers for the event table and the two rule tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.schema import ALERT_RULE, EVENTS, SCORING_RULE

SCORING_TYPE = "SCORING"

# --- Fixed values: the rule set a new deployment starts with ------------------
# id, title, fact, operator, operand, points, priority
DEFAULT_RULES = [
    ("severity-critical", "Critical severity", "rule.severity", "EQUAL_TO", "CRITICAL", 40, 10),
    ("severity-high", "High severity", "rule.severity", "EQUAL_TO", "HIGH", 30, 10),
    ("severity-medium", "Medium severity", "rule.severity", "EQUAL_TO", "MEDIUM", 20, 10),
    ("severity-low", "Low severity", "rule.severity", "EQUAL_TO", "LOW", 10, 10),
    ("action-deny", "Action deny", "action", "EQUAL_TO", "DENY", 20, 20),
    ("action-alert", "Action alert", "action", "EQUAL_TO", "ALERT", 10, 20),
    ("sensitive-path", "Sensitive path", "path", "CONTAINS_ANY", "/admin,/login", 15, 30),
    ("repeat-offender", "Repeat offender", "offenderEventCount", "GREATER_THAN", "5", 15, 40),
]
# ------------------------------------------------------------------------------


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table with its declared schema; filters and columns reach the Parquet scan."""
    return spark.read.schema(EVENTS).parquet(path)


def read_events_jdbc(spark: SparkSession, url: str, table: str = "events", **options: str) -> DataFrame:
    """The same table kept in a relational database (needs that database's driver)."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.withColumn("event_date", F.to_date("timestamp"))


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [
        (rule_id, SCORING_TYPE, title, fact_key, operator, operand, str(points), priority, True)
        for rule_id, title, fact_key, operator, operand, points, priority in DEFAULT_RULES
    ]
    return spark.createDataFrame(rows, SCORING_RULE)


def read_rules(
    rules: DataFrame, enabled_only: bool = True, rule_type: str = SCORING_TYPE, ordered: bool = True
) -> DataFrame:
    """Rules of one type in priority order; equal priorities order by id."""
    chosen = rules.filter(F.col("type") == rule_type)
    if enabled_only:
        chosen = chosen.filter("enabled")
    return chosen.orderBy("priority", "id") if ordered else chosen


def alert_rules(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Alert rules from (id or None, category, threshold, window minutes)."""
    filled = [(rule_id or str(uuid.uuid4()), *rest) for rule_id, *rest in rows]
    return spark.createDataFrame(filled, ALERT_RULE)


def save_alert_rules(rules: DataFrame, path: str) -> None:
    """Add alert rules to the stored ones; a rule without an id gets a new one."""
    named = rules.withColumn("id", F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.uuid()))
    named.select([F.col(f.name).cast(f.dataType) for f in ALERT_RULE.fields]).write.mode("append").parquet(path)


def read_alert_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_RULE).parquet(path)
