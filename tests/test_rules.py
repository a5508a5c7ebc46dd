import pytest
from build import raw_events, rows
from pyspark.sql import functions as F

from threatloom.functions.facts import Fact, fact, fact_keys
from threatloom.functions.predicates import OPERATORS, predicate
from threatloom.operators import rule_table, scoring
from threatloom.operators.enrich import score_events
from threatloom.schema import SCORING_RULE
from threatloom.sources.tables import default_rules, read_rules

CASES = [
    ("EQUAL_TO", "MEDIUM", "MEDIUM", True), ("EQUAL_TO", "MEDIUM", "medium", False), ("EQUAL_TO", "x", None, False),
    ("EQUAL_TO", "72", "72", True), ("EQUAL_TO", "8", "8.00", True), ("EQUAL_TO", "8", "\t8 ", True),
    ("EQUAL_TO", "Infinity", "inf", False), ("EQUAL_TO", "NaN", "NaN", True), ("EQUAL_TO", "2d", "2.0", True),
    ("NOT_EQUAL_TO", "BOT", "XSS", True), ("NOT_EQUAL_TO", "BOT", "BOT", False), ("NOT_EQUAL_TO", "BOT", None, False),
    ("GREATER_THAN", "31", "32.5", True), ("GREATER_THAN", "31", "31", False), ("GREATER_THAN", "31", None, False),
    ("GREATER_THAN", "9", "70", True), ("GREATER_THAN", "m", "n", True), ("GREATER_THAN", "9", "none", True),
    ("GREATER_THAN_OR_EQUAL", "2.5", "2.50", True), ("LESS_THAN", "7", "-1", True), ("LESS_THAN", "7", "12", False),
    ("LESS_THAN_OR_EQUAL", "0", "-0.0", True),
    ("IN", "HEAD, PATCH ,GET", "PATCH", True), ("IN", "HEAD, PATCH", "PUT", False), ("IN", "8", "8.0", False),
    ("IN", "HEAD,,", "", False), ("IN", ",", "", False), ("IN", ",HEAD", "", True),
    ("NOT_IN", "31, 32", "33", True), ("NOT_IN", "31, 32", "32", False), ("NOT_IN", "31", None, False),
    ("NOT_IN", ",", "y", True),
    ("CONTAINS_ANY", "bot,crawl", "a crawler", True), ("CONTAINS_ANY", "bot,crawl", "robot/7", True),
    ("CONTAINS_ANY", "bot,crawl", "browser/9", False), ("CONTAINS_ANY", "bot,crawl", None, False),
    ("CONTAINS", "west", "a.west.test", True), ("CONTAINS", "k,l", "jk,lm", True), ("CONTAINS", "k,l", "k", False),
    ("STARTS_WITH", "198.51.", "198.51.100.4", True), ("STARTS_WITH", "198.51.", "8.198.51.", False),
    ("ENDS_WITH", ".svg", "/media/logo.svg", True),
    ("REGEX_MATCH", "/feeds/[a-z]+", "/feeds/jobs", True), ("REGEX_MATCH", "/feeds", "/feeds/jobs", False),
    ("REGEX_MATCH", "*", "*", False), ("REGEX_MATCH", "x)(y", "xy", False), ("REGEX_MATCH", "end", "end\n", False),
    ("REGEX_MATCH", "t|te", "te", True),
    ("BETWEEN", "20,30", "20", True), ("BETWEEN", "20,30", "24.5", True), ("BETWEEN", "20,30", "30", True),
    ("BETWEEN", "20,30", "30.01", False), ("BETWEEN", "20", "20", False), ("BETWEEN", "3,5,7", "4", False),
    ("BETWEEN", "u,w", "v", False), ("BETWEEN", "20,30", "many", False), ("BETWEEN", "20,30", None, False),
    ("EXISTS", "true", "0", True), ("EXISTS", "true", None, False), ("EXISTS", "TRUE", "0", True),
    ("EXISTS", "false", None, True), ("EXISTS", "false", "0", False), ("EXISTS", "no", None, True),
]


def test_predicates(spark):
    frame = spark.createDataFrame([tuple(value for _, _, value, _ in CASES)], ", ".join(f"c{i} string" for i in range(len(CASES))))
    tests = [predicate(Fact(F.col(f"c{i}")), op, x).alias(f"c{i}") for i, (op, x, _, _) in enumerate(CASES)]
    got = frame.select(*tests).first()
    wrong = [(case, got[i]) for i, case in enumerate(CASES) if got[i] is not case[3]]
    assert wrong == []
    assert {case[0] for case in CASES} == set(OPERATORS)


def test_unknown_operator(spark):
    with pytest.raises(ValueError, match="invalid operator: LIKE"):
        predicate(Fact(F.lit("x")), "LIKE", "x")


def test_facts(spark):
    events = raw_events(spark, [{"country": "CN"}, {"timestamp": "2025-03-11T08:07:06.5Z"}])
    keys = ["rule.severity", "statusCode", "geoLocation.country", "path.length", "nope", "rule.nope", "action.", "geoLocation"]
    got = events.orderBy("arrival").select(*[fact(key).text for key in keys], fact("timestamp").text).collect()
    assert tuple(got[0]) == (
        "CRITICAL", "410", "CN", None, None, None, "DENY", "{country=CN, city=null}", "2025-03-11T08:07:06Z",
    )
    assert got[1][2] is None and got[1][7] is None and got[1][8] == "2025-03-11T08:07:06.500Z"
    assert fact("offenderEventCount", offender_count=F.lit(3)).number is not None
    assert fact_keys()[-1] == "offenderEventCount" and "geoLocation.city" in fact_keys() and "rule" not in fact_keys()


SCORES = [
    ("HIGH", "ALERT", "/login/reset", 9, 70), ("CRITICAL", "DENY", "/admin", 2, 75), ("CRITICAL", "ALERT", "/team", 1, 50),
    ("HIGH", "DENY", "/basket", 3, 50), ("MEDIUM", "DENY", "/feeds/news", 5, 40), ("MEDIUM", "ALERT", "/a/login/b", 6, 60),
    ("HIGH", "MONITOR", "/team", 7, 45), ("LOW", "ALERT", "/administer", 4, 35), ("LOW", "MONITOR", "/help/contact", 2, 10),
    ("CRITICAL", "DENY", "/login", 100, 90), ("MEDIUM", "MONITOR", "/ADMIN", 1, 20), ("LOW", "DENY", "/media/logo.svg", 6, 45),
]


def score(spark, rules, cases):
    events = raw_events(spark, [{"severity": s, "action": a, "path": p, **more} for s, a, p, _, more in cases])
    counts = spark.createDataFrame([(i, case[3]) for i, case in enumerate(cases)], "arrival long, offenderEventCount long")
    return [r[0] for r in rows(score_events(events.join(counts, "arrival"), rules).orderBy("arrival"), "threatScore")]


def rule(rule_id, key, operator, operand, points, priority=10, enabled=True, kind="SCORING"):
    return (rule_id, kind, rule_id, key, operator, operand, str(points), priority, enabled)


def test_default_scores(spark):
    cases = [(*case[:4], {}) for case in SCORES]
    assert score(spark, default_rules(spark), cases) == [case[4] for case in SCORES]


def test_cap_floor_and_extra_rule(spark):
    case = [("CRITICAL", "DENY", "/x", 0, {})]
    high = spark.createDataFrame([rule("a", "action", "EQUAL_TO", "DENY", 70), rule("b", "path", "EQUAL_TO", "/x", 50)], SCORING_RULE)
    assert score(spark, high, case) == [100]
    assert score(spark, spark.createDataFrame([rule("a", "action", "EQUAL_TO", "DENY", -5)], SCORING_RULE), case) == [0]
    assert score(spark, spark.createDataFrame([], SCORING_RULE), case) == [0]
    geo = default_rules(spark).union(
        spark.createDataFrame([rule("geo", "geoLocation.country", "EQUAL_TO", "CN", 5)], SCORING_RULE)
    )
    assert score(spark, geo, [("LOW", "MONITOR", "/x", 0, {}), ("LOW", "MONITOR", "/x", 0, {"country": "CN"})]) == [10, 15]


def test_many_rules_compile(spark):
    many = spark.createDataFrame([rule(f"r{i}", "statusCode", "EQUAL_TO", str(i), 1) for i in range(600)], SCORING_RULE)
    assert score(spark, many, [("LOW", "DENY", "/x", 0, {})]) == [1]


def test_matching_order_and_first(spark):
    table = spark.createDataFrame(
        [
            rule("late", "action", "EQUAL_TO", "DENY", 1, 30),
            rule("early", "path", "CONTAINS", "login", 2, 10),
            rule("off", "action", "EQUAL_TO", "DENY", 4, 1, enabled=False),
            rule("other", "action", "EQUAL_TO", "DENY", 4, 1, kind="ROUTING"),
            rule("no", "action", "EQUAL_TO", "ALERT", 8, 5),
        ],
        SCORING_RULE,
    )
    rules = scoring.compile_rules(table)
    event = raw_events(spark, [{}])
    got = event.select(scoring.matching_rules(rules).alias("m"), scoring.first_match(rules).alias("f")).first()
    assert [(m["id"], m["points"]) for m in got["m"]] == [("early", 2), ("late", 1)] and got["f"] == "early"
    none = raw_events(spark, [{"action": "MONITOR", "path": "/"}])
    got = none.select(scoring.matching_rules(rules).alias("m"), scoring.first_match(rules).alias("f")).first()
    assert got["m"] == [] and got["f"] is None
    assert dict(rows(scoring.rule_hits(event, rules), "rule_id", "hits")) == {"early": 1, "no": 0, "late": 1}


def test_read_rules(spark):
    table = default_rules(spark)
    assert table.count() == 8
    assert [r[0] for r in rows(read_rules(table), "priority")] == sorted(r[0] for r in rows(table, "priority"))
    off = table.withColumn("enabled", F.col("id") != "severity-low")
    assert read_rules(off).count() == 7 and read_rules(off, enabled_only=False).count() == 8


def test_rule_table_maintenance(spark, tmp_path):
    table = rule_table.seed_rules(spark, spark.createDataFrame([], SCORING_RULE))
    assert table.count() == 8
    assert rule_table.seed_rules(spark, table).count() == 8
    path = str(tmp_path / "rules")
    rule_table.write_rules(table, path)
    columns = [*SCORING_RULE.names, "change_order"]
    changes = spark.createDataFrame(
        [
            (*rule("severity-low", "rule.severity", "EQUAL_TO", "LOW", 11), 1),
            (*rule("severity-low", "rule.severity", "EQUAL_TO", "LOW", 12), 2),
            (*rule("  ", "path", "CONTAINS", "x", 1), 3),
            (*rule(None, "path", "CONTAINS", "y", 1), 4),
        ],
        schema=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCORING_RULE.fields) + ", change_order long",
    ).select(*columns)
    stored = rule_table.load_rules(spark, path)
    rule_table.write_rules(rule_table.upsert_rules(stored, changes), path)
    after = rule_table.load_rules(spark, path)
    by_id = dict(rows(after, "id", "output"))
    assert len(by_id) == 10 and by_id["severity-low"] == "12" and None not in by_id and "  " not in by_id
    gone = rule_table.delete_rules(after, spark.createDataFrame([("severity-low",), ("unknown",)], "id string"))
    assert gone.count() == 9
    rule_table.write_rules(gone, path)
    assert rule_table.load_rules(spark, path).count() == 9


def test_rule_validation(spark):
    table = spark.createDataFrame(
        [rule(" ok ", "no.such.fact", "IN", " a ", 1), rule(" ", "", "LIKE", None, 1)], SCORING_RULE
    )
    good, bad = rule_table.validate_rules(table).orderBy(F.desc("id")).collect()
    assert good["violations"] == [] and good["title"] == "ok" and good["operand"] == "a"
    assert [v["field"] for v in bad["violations"]] == ["title", "fact_key", "operand", "operator"]
