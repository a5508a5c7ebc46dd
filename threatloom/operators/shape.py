"""Conversions between the nested event, the flat table row and the sample response."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.schema import EVENT_COLUMNS

# flat column -> path below the raw event
_RAW_PATHS = {
    "event_id": "eventId",
    "timestamp": "timestamp",
    "config_id": "configId",
    "policy_id": "policyId",
    "client_ip": "clientIp",
    "hostname": "hostname",
    "path": "path",
    "method": "method",
    "status_code": "statusCode",
    "user_agent": "userAgent",
    "rule_id": "rule.id",
    "rule_name": "rule.name",
    "rule_message": "rule.message",
    "severity": "rule.severity",
    "category": "rule.category",
    "action": "action",
    "geo_country": "geoLocation.country",
    "geo_city": "geoLocation.city",
    "request_size": "requestSize",
    "response_size": "responseSize",
}
_DERIVED = {"attack_type": "attackType", "threat_score": "threatScore", "received_at": "receivedAt"}


def to_stored(enriched: DataFrame, at: str = "") -> DataFrame:
    """Flatten (rawEvent, attackType, threatScore, receivedAt) to the 23 table columns.

    `at` names the struct that holds the enriched event (`payload.` for envelopes). Missing
    `rule` or `geoLocation` structs give nulls. Rows without an event id are not events.
    """
    raw = [F.col(f"{at}rawEvent.{path}").alias(column) for column, path in _RAW_PATHS.items()]
    derived = [F.col(f"{at}{name}").alias(column) for column, name in _DERIVED.items()]
    return enriched.select(*raw, *derived).filter(F.col("event_id").rlike(r"[^\x00-\x20]"))


def _rule() -> Column:
    return F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_name").alias("name"),
        F.col("rule_message").alias("message"),
        F.col("severity"),
        F.col("category"),
    )


def _geo() -> Column:
    return F.struct(F.col("geo_country").alias("country"), F.col("geo_city").alias("city"))


def _document(rule: Column, geo: Column) -> list[Column]:
    nested = {"rule_id": rule.alias("rule"), "geo_country": geo.alias("geoLocation")}
    inside = {"rule_name", "rule_message", "severity", "category", "geo_city"}
    names = {**{c: p for c, p in _RAW_PATHS.items()}, **_DERIVED}
    return [nested[c] if c in nested else F.col(c).alias(names[c]) for c in EVENT_COLUMNS if c not in inside]


def to_nested(stored: DataFrame) -> DataFrame:
    """Rebuild the nested record; `rule` or `geoLocation` is null only if all its parts are."""
    any_rule = F.coalesce("rule_id", "rule_name", "rule_message", "severity", "category").isNotNull()
    any_geo = F.coalesce("geo_country", "geo_city").isNotNull()
    return stored.select(_document(F.when(any_rule, _rule()), F.when(any_geo, _geo())))


def to_response(stored: DataFrame) -> DataFrame:
    """The shape of a sample: `rule` and `geoLocation` are always objects."""
    return stored.select(_document(_rule(), _geo()))
