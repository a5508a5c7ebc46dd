import json

from build import rows
from pyspark.sql import functions as F

from threatloom.operators.enrich import enrich
from threatloom.operators.ingest import POSITION_BITS, accepted, check_messages, correlation_id, rejected
from threatloom.operators.windows import STRETCH
from threatloom.sources.tables import default_rules
from threatloom.streaming.logs import bad, good, kafka_messages, raw_messages, read_raw

EVENT = {
    "eventId": "k-1", "timestamp": "2025-03-11T08:07:06Z", "configId": 31, "clientIp": "192.0.2.200",
    "path": "/login/start", "statusCode": 410,
    "rule": {"id": "7001", "name": "sig-one", "message": "seen", "severity": "CRITICAL", "category": "INJECTION"},
    "action": "DENY", "requestSize": 300, "responseSize": 90,
}


def event(**changes):
    return {**{k: v for k, v in EVENT.items() if k not in changes or changes[k] is not None}, **{k: v for k, v in changes.items() if v is not None}}


def ruled(**changes):
    return event(rule={k: v for k, v in {**EVENT["rule"], **changes}.items() if v is not None})


def check(spark, bodies):
    values = [(i, b if isinstance(b, str) else json.dumps(b), None) for i, b in enumerate(bodies)]
    return check_messages(spark.createDataFrame(values, "arrival long, value string, correlation string"))


def test_verdicts(spark):
    cases = [
        (EVENT, None, 1),
        ([EVENT, EVENT], None, 2),
        ([], None, 0),
        ([EVENT, event(clientIp=None)], "VALIDATION_FAILED", 0),
        (event(action="NOPE"), "MALFORMED_REQUEST", 0),
        (event(eventId=None), "VALIDATION_FAILED", 0),
        ("{not json", "MALFORMED_REQUEST", 0),
        ("", "MALFORMED_REQUEST", 0),
        ("5", "MALFORMED_REQUEST", 0),
        ([EVENT, 5], "MALFORMED_REQUEST", 0),
        ([EVENT, None], "MALFORMED_REQUEST", 0),
        (event(statusCode="abc"), "MALFORMED_REQUEST", 0),
        (event(statusCode=2**40), "MALFORMED_REQUEST", 0),
        (event(statusCode="410"), None, 1),
        (event(statusCode=410.9), None, 1),
        (event(statusCode=None, configId=None, requestSize=None), None, 1),
        (event(timestamp="2025-03-11"), "MALFORMED_REQUEST", 0),
        (event(timestamp="2025-13-11T08:07:06Z"), "MALFORMED_REQUEST", 0),
        (event(timestamp="2025-03-11T10:07:06.123456+02:00"), None, 1),
        (event(rule="text"), "MALFORMED_REQUEST", 0),
        (event(geoLocation=[1]), "MALFORMED_REQUEST", 0),
        (ruled(severity="URGENT"), "MALFORMED_REQUEST", 0),
        (event(unknownField=1), None, 1),
    ]
    got = rows(check(spark, [body for body, _, _ in cases]).orderBy("arrival"), "error_code", "accepted_count")
    wrong = [(cases[i][0], got[i]) for i in range(len(cases)) if got[i] != cases[i][1:]]
    assert wrong == []


def test_violation_texts(spark):
    body = [event(clientIp=" \t", rule=None), ruled(id="", severity=None), event(timestamp=None, path=None, action=None)]
    found = check(spark, [body]).first()["violations"]
    assert [tuple(v) for v in found] == [
        ("[0].clientIp", "must not be blank"), ("[0].rule", "must not be null"),
        ("[1].rule.id", "must not be blank"), ("[1].rule.severity", "must not be null"),
        ("[2].timestamp", "must not be null"), ("[2].path", "must not be blank"), ("[2].action", "must not be null"),
    ]


def test_malformed_messages_list_no_violations(spark):
    assert check(spark, [[event(clientIp=None), event(action="NOPE")]]).first()["violations"] == []


def test_accepted_envelopes(spark):
    messages = spark.createDataFrame(
        [
            (1, json.dumps([event(eventId="a"), event(eventId="b", geoLocation={"country": "CN"}, statusCode=None)]), "corr-7"),
            (2, json.dumps(EVENT), "  "),
            (3, json.dumps([EVENT, event(path=None)]), "corr-8"),
        ],
        "arrival long, value string, correlation string",
    )
    checked = check_messages(messages)
    out = accepted(checked).orderBy("arrival", "position").collect()
    assert [(r["payload"]["eventId"], r["version"]) for r in out] == [("a", 1), ("b", 1), ("k-1", 1)]
    assert out[0]["correlationId"] == out[1]["correlationId"] == "corr-7" and len(out[2]["correlationId"]) == 36
    assert out[0]["occurredAt"] == out[1]["occurredAt"]
    assert out[0]["payload"]["geoLocation"] is None and out[1]["payload"]["geoLocation"]["city"] is None
    assert out[1]["payload"]["statusCode"] == 0 and out[0]["payload"]["requestSize"] == 300
    lost = rejected(checked).collect()
    assert [(r["arrival"], r["error_code"]) for r in lost] == [(3, "VALIDATION_FAILED")] and lost[0]["value"]


def test_no_shuffle_before_the_verdict(spark):
    plan = accepted(check(spark, [EVENT]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_log_round_trip_and_bad_messages(spark):
    envelopes = accepted(check(spark, [event(timestamp="2025-03-11T08:07:06.123456Z")]))
    messages = raw_messages(envelopes)
    assert rows(messages, "key") == [("192.0.2.200",)]
    broken = messages.withColumn("value", F.lit("{oops"))
    opened = read_raw(messages.union(broken))
    assert good(opened).count() == 1 and rows(bad(opened), "value") == [("{oops",)]
    instant = good(opened).select(F.unix_micros("payload.timestamp") % 1_000_000).first()[0]
    assert instant == 123456


def test_kafka_columns(spark):
    records = spark.sql(
        """SELECT CAST('k' AS BINARY) AS key, CAST('v' AS BINARY) AS value, CAST(7 AS BIGINT) AS offset, 3 AS partition,
           array(struct('x-correlation-id' AS key, CAST('old' AS BINARY) AS value),
                 struct('other' AS key, CAST('z' AS BINARY) AS value),
                 struct('x-correlation-id' AS key, CAST('new' AS BINARY) AS value)) AS headers"""
    )
    assert rows(kafka_messages(records), "key", "value", "correlation", "arrival") == [("k", "v", "new", 7 * 64 + 3)]
    bare = records.withColumn("headers", F.lit(None).cast(records.schema["headers"].dataType))
    assert rows(kafka_messages(bare), "correlation") == [(None,)]


def test_repeats_inside_one_message(spark):
    """Items of one message share its place in the log but stay distinct events."""
    envelopes = accepted(check(spark, [[EVENT, EVENT, event(eventId="k-2")]]))
    assert sorted(rows(envelopes, "arrival")) == [(0,), (1,), (2,)]
    raw = envelopes.selectExpr("arrival", "occurredAt AS received_at", "payload AS rawEvent")
    scored = enrich(raw, default_rules(spark), stretch=STRETCH << POSITION_BITS)
    assert sorted(rows(scored, "rawEvent.eventId", "offenderEventCount")) == [("k-1", 1), ("k-2", 2)]


def test_correlation_headers(spark):
    headers = spark.createDataFrame([("a",), ("  ",), ("",), (None,)], "h string")
    request = [len(r[0]) for r in headers.select(correlation_id(F.col("h"))).collect()]
    message = [len(r[0]) for r in headers.select(correlation_id(F.col("h"), blank_counts=True)).collect()]
    assert request == [1, 36, 36, 36] and message == [1, 2, 36, 36]
