"""Rule patterns and rule tables at their edges, values of the wrong JSON type, log positions out of range."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from threatloom.functions.facts import Fact
from threatloom.functions.predicates import predicate
from threatloom.operators import ingest, rule_table
from threatloom.sources.tables import default_rules


@pytest.mark.parametrize(
    ("pattern", "value", "expected"),
    [
        (r"\Qx.y", "x.y", True),
        (r"\Qx.y", "xzy", False),
        ("(?x)no w # spaces and remarks do not count", "now", True),
        ("(?x)no w # spaces and remarks do not count", "nowhere", False),
        ("a|bc", "bc", True),
        ("a|bc", "abc", False),
        ("(", "(", False),
    ],
)
def test_patterns(spark, pattern, value, expected):
    frame = spark.createDataFrame([(value,)], "v string")
    assert frame.select(predicate(Fact(F.col("v"), None), "REGEX_MATCH", pattern)).first()[0] is expected


def test_last_rules_can_go(spark, tmp_path):
    path = str(tmp_path / "rules")
    rule_table.write_rules(default_rules(spark), path)
    stored = rule_table.load_rules(spark, path)
    rule_table.write_rules(rule_table.delete_rules(stored, stored.select("id")), path)
    assert rule_table.load_rules(spark, path).count() == 0
    rule_table.write_rules(default_rules(spark).limit(2), path)
    assert rule_table.load_rules(spark, path).count() == 2


BODY = {
    "eventId": "k", "timestamp": "2025-02-03T04:05:06Z", "clientIp": "192.0.2.9", "path": "/x", "action": "ALERT",
    "rule": {"id": "7", "name": "n", "severity": "LOW", "category": "BOT"},
}


@pytest.mark.parametrize(
    ("change", "malformed"),
    [
        ({}, False),
        ({"eventId": 5}, False),
        ({"extra": {"path": []}}, False),
        ({"eventId": {"a": 1}}, True),
        ({"path": ["/x"]}, True),
        ({"rule": json.dumps(BODY["rule"])}, True),
        ({"rule": {**BODY["rule"], "id": {}}}, True),
        ({"geoLocation": "{}"}, True),
        ({"geoLocation": {"country": []}}, True),
        ({"geoLocation": None}, False),
    ],
)
def test_types(spark, change, malformed):
    for value in (json.dumps({**BODY, **change}), json.dumps([BODY, {**BODY, **change}])):
        sent = spark.createDataFrame([(None, value, None, 1)], "key string, value string, correlation string, arrival long")
        assert (ingest.check_messages(sent).first()["error_code"] == ingest.MALFORMED) is malformed


def test_no_position_wraps_round(spark):
    sent = spark.createDataFrame([(None, json.dumps(BODY), None, 1 << 40)], "key string, value string, correlation string, arrival long")
    with pytest.raises(PySparkException, match="out of range"):
        ingest.accepted(ingest.check_messages(sent)).select("arrival").collect()
