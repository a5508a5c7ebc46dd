"""Explicit schemas and fixed vocabularies; nothing is ever inferred."""

from pyspark.sql import types as T

# --- Fixed values: vocabularies that results must agree on -------------------
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

ACTIONS = ["DENY", "ALERT", "MONITOR"]

ATTACK_TYPES = {
    "INJECTION": "SQL/Command Injection",
    "XSS": "Cross-Site Scripting",
    "PROTOCOL_VIOLATION": "Protocol Anomaly",
    "DATA_LEAKAGE": "Data Exfiltration",
    "BOT": "Bot Activity",
    "DOS": "Denial of Service",
    "RATE_LIMIT": "Rate Limiting",
}

CATEGORIES = list(ATTACK_TYPES)

INTERVAL_SECONDS = {"1m": 60, "5m": 300, "1h": 3600}

ENVELOPE_VERSION = 1
OFFENDER_WINDOW_SECONDS = 600
DEDUP_RETENTION_SECONDS = 3600
# -----------------------------------------------------------------------------


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, INT, LONG, TIMESTAMP = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

RULE = _struct(id=STRING, name=STRING, message=STRING, severity=STRING, category=STRING)

GEO = _struct(country=STRING, city=STRING)

RAW_EVENT = _struct(
    eventId=STRING,
    timestamp=TIMESTAMP,
    configId=INT,
    policyId=STRING,
    clientIp=STRING,
    hostname=STRING,
    path=STRING,
    method=STRING,
    statusCode=INT,
    userAgent=STRING,
    rule=RULE,
    action=STRING,
    geoLocation=GEO,
    requestSize=LONG,
    responseSize=LONG,
)

ENRICHED_EVENT = _struct(rawEvent=RAW_EVENT, attackType=STRING, threatScore=INT, receivedAt=TIMESTAMP)


def envelope(payload: T.StructType) -> T.StructType:
    return _struct(correlationId=STRING, occurredAt=TIMESTAMP, version=INT, payload=payload)


RAW_ENVELOPE = envelope(RAW_EVENT)
ENRICHED_ENVELOPE = envelope(ENRICHED_EVENT)

# A transport message: what a Kafka topic or a folder of JSON lines delivers.
# `arrival` is the position in the log, unique and rising for each key.
MESSAGE = _struct(key=STRING, value=STRING, correlation=STRING, arrival=LONG)

EVENT_COLUMNS = [
    "event_id", "timestamp", "config_id", "policy_id", "client_ip", "hostname", "path", "method",
    "status_code", "user_agent", "rule_id", "rule_name", "rule_message", "severity", "category",
    "action", "geo_country", "geo_city", "request_size", "response_size", "attack_type",
    "threat_score", "received_at",
]

EVENTS = _struct(
    event_id=STRING,
    timestamp=TIMESTAMP,
    config_id=INT,
    policy_id=STRING,
    client_ip=STRING,
    hostname=STRING,
    path=STRING,
    method=STRING,
    status_code=INT,
    user_agent=STRING,
    rule_id=STRING,
    rule_name=STRING,
    rule_message=STRING,
    severity=STRING,
    category=STRING,
    action=STRING,
    geo_country=STRING,
    geo_city=STRING,
    request_size=LONG,
    response_size=LONG,
    attack_type=STRING,
    threat_score=INT,
    received_at=TIMESTAMP,
    event_date=T.DateType(),
)

SCORING_RULE = _struct(
    id=STRING,
    type=STRING,
    title=STRING,
    fact_key=STRING,
    operator=STRING,
    operand=STRING,
    output=STRING,
    priority=INT,
    enabled=T.BooleanType(),
)

ALERT_RULE = _struct(id=STRING, category=STRING, threshold=INT, window_minutes=INT)
