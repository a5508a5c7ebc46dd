"""Small tables for the tests."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.schema import EVENT_COLUMNS, EVENTS, RAW_EVENT


def at(text: str):
    return F.lit(text).cast("timestamp")


def raw_events(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """(arrival, received_at, rawEvent) from rows with a few overrides each."""
    base = {
        "eventId": "k-1", "timestamp": "2025-03-11T08:07:06Z", "configId": 31, "clientIp": "192.0.2.200",
        "path": "/login/start", "statusCode": 410, "action": "DENY", "severity": "CRITICAL", "category": "INJECTION",
        "country": None, "city": None, "received_at": "2025-03-11T08:00:00Z", "requestSize": 300, "responseSize": 90,
    }
    filled = [{**base, "arrival": i, **row} for i, row in enumerate(rows)]
    schema = (
        "eventId string, timestamp string, configId int, clientIp string, path string, statusCode int, action string,"
        "severity string, category string, country string, city string, received_at string, requestSize long,"
        "responseSize long, arrival long"
    )
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    flat = spark.createDataFrame([tuple(row[name] for name in names) for row in filled], schema)
    geo = F.when(F.col("country").isNotNull() | F.col("city").isNotNull(), F.struct("country", "city"))
    own = {
        "timestamp": F.col("timestamp").cast("timestamp"),
        "rule": F.struct(
            F.lit("7001").alias("id"), F.lit("sig-one").alias("name"), F.lit("seen").alias("message"), "severity", "category"
        ),
        "geoLocation": geo,
    }
    fields = [
        own.get(f.name, F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in RAW_EVENT.fields
    ]
    return flat.select("arrival", F.col("received_at").cast("timestamp"), F.struct(*fields).alias("rawEvent"))


def stored(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of the event table; columns not given are null."""
    kinds = {f.name: f.dataType for f in EVENTS.fields}
    given = sorted({name for row in rows for name in row})
    frame = spark.createDataFrame(
        [tuple(None if row.get(n) is None else str(row[n]) for n in given) for row in rows],
        ", ".join(f"{n} string" for n in given),
    )
    return frame.select(
        [(F.col(n).cast(kinds[n]) if n in given else F.lit(None).cast(kinds[n])).alias(n) for n in EVENT_COLUMNS]
    )


def set_a(spark: SparkSession) -> DataFrame:
    """Eight events of twenty minutes, one of them of another configuration."""
    rows = [
        ("a1", "01:00", "192.0.2.200", "/login/start", "INJECTION", "DENY", 64, 31),
        ("a2", "03:20", "192.0.2.200", "/login/start", "INJECTION", "ALERT", 52, 31),
        ("a3", "05:50", "198.51.100.90", "/basket", "BOT", "DENY", 33, 31),
        ("a4", "08:20", "192.0.2.200", "/admin/audit", "INJECTION", "DENY", 97, 31),
        ("a5", "11:40", "198.51.100.90", "/basket", "BOT", "MONITOR", 21, 31),
        ("a6", "15:00", "198.51.100.90", "/admin/audit", "DOS", "DENY", 45, 31),
        ("a7", "16:40", "203.0.113.8", "/team", "XSS", "MONITOR", 10, 31),
        ("b1", "21:40", "203.0.113.9", "/feeds/news", "DATA_LEAKAGE", "DENY", 70, 77),
    ]
    names = ("event_id", "timestamp", "client_ip", "path", "category", "action", "threat_score", "config_id")
    return stored(spark, [dict(zip(names, (row[0], f"2025-09-02T10:{row[1]}Z", *row[2:]), strict=True)) for row in rows])


def rows(frame: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(row) for row in frame.select(*columns).collect()]
