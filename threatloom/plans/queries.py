"""One registered query per operator, each over the whole tables of a test-data folder."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.facts import fact
from threatloom.functions.predicates import predicate
from threatloom.functions.scalars import attack_type, client_key
from threatloom.operators import alerts, analytics, ingest, quota, rollup, rule_table, scoring, shape, store, summary
from threatloom.operators.enrich import client_ip, enrich, event_id
from threatloom.operators.windows import first_sight, offender_count
from threatloom.plans.sql import ALERT_RULES, ALERTS_AS_OF, FILTER_FROM, FILTER_TO, RULE_CASES
from threatloom.schema import MESSAGE
from threatloom.session import scratch_dir
from threatloom.sources import tables, testdata
from threatloom.streaming import enrichment, gateway, live, logs, state, storing

Query = Callable[[SparkSession, str], DataFrame]

# Questions that are also asked of every stored event.
_UNFILTERED = {
    "total_events": analytics.total_events,
    "by_category": analytics.by_category,
    "by_action": analytics.by_action,
    "top_attackers": analytics.top_attackers,
    "top_paths": analytics.top_paths,
    "summary": summary.summary,
    **{f"timeseries_{width}": partial(analytics.timeseries, interval=width) for width in ("1m", "5m", "1h")},
}


def _naive(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock values, which is what the comparison tables hold."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat event table, scored without the rolling count: no shuffle."""
    scored = scoring.compile_rules(tables.default_rules(spark))
    return shape.to_stored(
        testdata.raw_events(spark, sf_dir).select(
            "rawEvent",
            attack_type(F.col("rawEvent.rule.category")).alias("attackType"),
            scoring.threat_score(scored).alias("threatScore"),
            F.col("received_at").alias("receivedAt"),
        )
    )


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.filter_events(stored_events(spark, sf_dir), testdata.CONFIG_IDS[0], FILTER_FROM, FILTER_TO)


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = testdata.with_redeliveries(testdata.raw_events(spark, sf_dir))
    return enrich(raw, tables.default_rules(spark))


# --- events and rules --------------------------------------------------------------------


def classify(spark, sf_dir):
    raw = testdata.raw_events(spark, sf_dir)
    return raw.select(event_id().alias("event_id"), attack_type(F.col("rawEvent.rule.category")).alias("attack_type"))


def facts_dotted(spark, sf_dir):
    keys = {
        "rule_severity": "rule.severity",
        "geo_country": "geoLocation.country",
        "status_code": "statusCode",
        "event_time": "timestamp",
        "unknown_key": "rule.colour",
        "below_text": "path.length",
    }
    raw = testdata.raw_events(spark, sf_dir)
    return raw.select(event_id().alias("event_id"), *[fact(key).text.alias(name) for name, key in keys.items()])


def rule_predicate(operator, spark, sf_dir):
    key, operand, _ = RULE_CASES[operator]
    raw = testdata.raw_events(spark, sf_dir)
    return raw.select(event_id().alias("event_id"), predicate(fact(key), operator, operand).alias("matched"))


def rule_first_match(spark, sf_dir):
    rules = scoring.compile_rules(tables.default_rules(spark))
    return testdata.raw_events(spark, sf_dir).select(event_id().alias("event_id"), scoring.first_match(rules).alias("rule_id"))


def matching_rules(spark, sf_dir):
    rules = scoring.compile_rules(tables.default_rules(spark))
    ids = F.concat_ws(",", scoring.matching_rules(rules)["id"])
    return testdata.raw_events(spark, sf_dir).select(event_id().alias("event_id"), ids.alias("rule_ids"))


def rule_hits(spark, sf_dir):
    return scoring.rule_hits(testdata.raw_events(spark, sf_dir), scoring.compile_rules(tables.default_rules(spark)))


def threat_score(spark, sf_dir):
    return stored_events(spark, sf_dir).select("event_id", "threat_score")


def offender(collapse_millis, spark, sf_dir):
    counted = offender_count(testdata.raw_events(spark, sf_dir), client_ip(), F.col("received_at"), collapse_millis=collapse_millis)
    return counted.select("arrival", F.col("offenderEventCount").alias("offender_count"))


def first_sights(spark, sf_dir):
    raw = testdata.with_redeliveries(testdata.raw_events(spark, sf_dir))
    return first_sight(raw, event_id()).select(event_id().alias("event_id"), "arrival")


def enriched_events(spark, sf_dir):
    return _naive(
        _enriched(spark, sf_dir).select(
            event_id().alias("event_id"),
            F.col("offenderEventCount").alias("offender_count"),
            F.col("threatScore").alias("threat_score"),
            F.col("attackType").alias("attack_type"),
            "received_at",
        )
    )


def enriched_by_category(spark, sf_dir):
    """The flagship: events arrive, repeats drop out, clients are counted, rules score, categories add up."""
    return analytics.by_category(shape.to_stored(_enriched(spark, sf_dir)))


def enriched_summary(spark, sf_dir):
    return summary.summary(shape.to_stored(_enriched(spark, sf_dir)))


# --- analytics -----------------------------------------------------------------------------


def over_all(question, spark, sf_dir):
    return _naive(question(stored_events(spark, sf_dir)))


def over_filtered(question, spark, sf_dir):
    return _naive(question(_filtered(spark, sf_dir)))


def summary_document(of, spark, sf_dir):
    document = summary.summary_document(summary.summary(of(spark, sf_dir)))
    none = F.lit(None).cast("double")

    def part(name, entries, key, count, average):
        # One document row, so this explode yields a few dozen rows.
        return document.select(F.explode(entries).alias("e")).select(
            F.lit(name).alias("part"), key.alias("key"), count.alias("event_count"), average.alias("average")
        )

    e = F.col("e")
    by_category = part("byCategory", F.map_entries("byCategory"), e["key"], e["value"]["count"], e["value"]["avgThreatScore"])
    by_action = part("byAction", F.map_entries("byAction"), e["key"], e["value"], none)
    attackers = part("topAttackers", F.col("topAttackers"), e["clientIp"], e["count"], e["avgThreatScore"])
    paths = part("topTargetedPaths", F.col("topTargetedPaths"), e["path"], e["count"], none)
    total = part("totalEvents", F.array("totalEvents"), F.lit(None).cast("string"), e, none)
    return by_category.unionByName(by_action).unionByName(attackers).unionByName(paths).unionByName(total)


def find_by_config(spark, sf_dir):
    return analytics.find_by_config(stored_events(spark, sf_dir), testdata.CONFIG_IDS[1]).select("event_id", "config_id", "path")


def count_all(spark, sf_dir):
    return store.count_all(stored_events(spark, sf_dir))


def _sampled(spark, sf_dir):
    return analytics.filter_events(stored_events(spark, sf_dir), category="INJECTION", action="ALERT")


def samples_page(spark, sf_dir):
    page = analytics.samples_page(_sampled(spark, sf_dir), limit=500, offset=40)
    return _naive(page.select("event_id", "timestamp", "category", "threat_score"))


def samples_deep_page(spark, sf_dir):
    page = analytics.samples_page(stored_events(spark, sf_dir), limit=100, offset=9950)
    return _naive(page.select("event_id", "timestamp"))


def samples_total(spark, sf_dir):
    return analytics.samples_total(_sampled(spark, sf_dir))


def samples_response(spark, sf_dir):
    response = shape.to_response(stored_events(spark, sf_dir))
    return response.select(
        F.col("eventId").alias("event_id"),
        F.col("rule.id").alias("rule_id"),
        F.col("rule.severity").alias("severity"),
        F.col("geoLocation.country").alias("geo_country"),
        F.col("rule").isNull().alias("rule_missing"),
        F.col("geoLocation").isNull().alias("geo_missing"),
    )


def count_category_within(spark, sf_dir):
    return analytics.count_category_within(stored_events(spark, sf_dir), "XSS", FILTER_FROM, FILTER_TO)


_ALERT_COLUMNS = ["rule_id", "category", "threshold", "window_minutes", "event_count", "firing"]


def evaluated_alerts(spark, sf_dir):
    rules = tables.alert_rules(spark, ALERT_RULES)
    return alerts.evaluate_alerts(stored_events(spark, sf_dir), rules, ALERTS_AS_OF).select(*_ALERT_COLUMNS)


def alert_rules_stored(spark, sf_dir):
    """A rule per category, saved and read back: more events in a week than it has denied ones in all."""
    events = stored_events(spark, sf_dir)
    denied = (F.count_if(F.col("action") == "DENY") + 1).alias("threshold")
    rules = events.groupBy("category").agg(denied).withColumns(
        {"id": F.concat(F.lit("rule-"), F.col("category")), "window_minutes": F.lit(10080)}
    )
    path = scratch_dir(spark, "alert-rules")
    tables.save_alert_rules(rules, path)
    return alerts.evaluate_alerts(events, tables.read_alert_rules(spark, path), ALERTS_AS_OF).select(*_ALERT_COLUMNS)


def alert_rule_violations(spark, sf_dir):
    """One alert rule per event, a part of them unusable."""
    k = testdata.kind(F.col("rawEvent.requestSize"))
    rules = testdata.raw_events(spark, sf_dir).select(
        event_id().alias("id"),
        F.when(k % 6 != 0, F.col("rawEvent.rule.category")).alias("category"),
        (k % 9).alias("threshold"),
        (k % 4).alias("window_minutes"),
    )
    checked = alerts.validate_alert_rules(rules)
    return checked.select(F.col("id").alias("event_id"), F.explode("violations.field").alias("field"))


def _quota_log(spark, sf_dir):
    log = testdata.access_log(spark, sf_dir)
    return log.withColumn("client", client_key(F.col("forwarded_for"), F.col("remote_addr")))


def quota_flags(spark, sf_dir):
    flagged = quota.flag_quota(_quota_log(spark, sf_dir), F.col("client"), F.col("ts"), limit=3, window_seconds=60)
    return flagged.select("arrival", "client", "request_number", "allowed")


def client_keys(spark, sf_dir):
    return _quota_log(spark, sf_dir).select("arrival", "client")


# --- ingest and logs -----------------------------------------------------------------------


def _checked(spark, sf_dir):
    return ingest.check_messages(testdata.ingest_messages(spark, sf_dir))


def ingest_verdicts(spark, sf_dir):
    return _checked(spark, sf_dir).select("message_id", "error_code", "accepted_count")


def ingest_violations(spark, sf_dir):
    return _checked(spark, sf_dir).select("message_id", F.inline("violations"))


def ingest_accepted(spark, sf_dir):
    event = F.col("payload")
    return _naive(
        ingest.accepted(_checked(spark, sf_dir)).select(
            event["eventId"].alias("event_id"),
            event["timestamp"].alias("timestamp"),
            event["configId"].alias("config_id"),
            event["clientIp"].alias("client_ip"),
            event["path"].alias("path"),
            event["statusCode"].alias("status_code"),
            event["rule"]["id"].alias("rule_id"),
            event["rule"]["severity"].alias("severity"),
            event["rule"]["category"].alias("category"),
            event["action"].alias("action"),
            event["geoLocation"]["city"].alias("geo_city"),
            event["requestSize"].alias("request_size"),
        )
    )


def ingest_rejected(spark, sf_dir):
    return ingest.rejected(_checked(spark, sf_dir)).groupBy("error_code").agg(F.count(F.lit(1)).alias("messages"))


def correlation(spark, sf_dir):
    """New ids are random, so only their form is compared."""
    given = ingest.correlation_id(F.col("correlation"))
    shown = F.when(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "new").otherwise(F.col("id"))
    messages = testdata.ingest_messages(spark, sf_dir).select("message_id", given.alias("id"))
    return messages.select("message_id", shown.alias("correlation_id"))


def raw_log(spark, sf_dir):
    messages = logs.raw_messages(ingest.accepted(_checked(spark, sf_dir)))
    opened = logs.good(logs.read_raw(messages))
    return _naive(
        opened.select(
            F.col("payload.clientIp").alias("key"),
            F.col("payload.eventId").alias("event_id"),
            F.col("payload.timestamp").alias("timestamp"),
            "version",
        )
    )


def _envelopes(payload: DataFrame) -> DataFrame:
    return payload.select(
        "arrival",
        F.concat(F.lit("corr-"), F.col("arrival").cast("string")).alias("correlationId"),
        F.col("received_at").alias("occurredAt"),
        F.lit(1).alias("version"),
        "payload",
    )


def enriched_log(spark, sf_dir):
    scored = testdata.raw_events(spark, sf_dir).select(
        "arrival",
        "received_at",
        F.struct(
            "rawEvent",
            attack_type(F.col("rawEvent.rule.category")).alias("attackType"),
            scoring.threat_score(scoring.compile_rules(tables.default_rules(spark))).alias("threatScore"),
            F.col("received_at").alias("receivedAt"),
        ).alias("payload"),
    )
    messages = logs.enriched_messages(_envelopes(scored))
    stored = shape.to_stored(logs.good(logs.read_enriched(messages)), "payload.")
    return _naive(
        stored.select(F.col("config_id").cast("string").alias("key"), "event_id", "threat_score", "attack_type", "received_at")
    )


# --- hourly rows beside the table ------------------------------------------------------------


def _half_rolled(spark: SparkSession, sf_dir: str) -> str:
    """A stored table whose second half was appended after its hourly rows were made."""
    path = scratch_dir(spark, "rolled")
    events = stored_events(spark, sf_dir).withColumn("event_date", F.to_date("timestamp"))
    odd = F.col("event_id").cast("bigint") % 2 == 1
    store.write_events(events.filter(odd), path)
    rollup.refresh(spark, path)
    store.write_events(events.filter(~odd), path)
    return path


def rolled_question(question, conditions, spark, sf_dir):
    return _naive(question(rollup.rolled(spark, _half_rolled(spark, sf_dir), **conditions)))


def rolled_page(spark, sf_dir):
    path = _half_rolled(spark, sf_dir)
    page = analytics.samples_page(tables.read_events(spark, path), limit=100, offset=9950, counts=rollup.rolled(spark, path))
    return _naive(page.select("event_id", "timestamp"))


# --- store and rule table ------------------------------------------------------------------


def flatten_roundtrip(spark, sf_dir):
    nested = shape.to_nested(stored_events(spark, sf_dir))
    derived = ["attackType", "threatScore", "receivedAt"]
    enriched = nested.select(F.struct(*[c for c in nested.columns if c not in derived]).alias("rawEvent"), *derived)
    return _naive(shape.to_stored(enriched))


def append_once(spark, sf_dir):
    """All events written, then all of them again: the second write adds nothing."""
    path = scratch_dir(spark, "append-once")
    events = stored_events(spark, sf_dir)
    store.append_once(events, path)
    store.append_once(events, path, ids_keep_their_day=True)
    return _naive(tables.read_events(spark, path).drop("event_date"))


def append_changed_days(spark, sf_dir):
    """A filled table, then all events again two days later under default settings, with every seventh under a new id."""
    path = scratch_dir(spark, "append-changed")
    events = stored_events(spark, sf_dir)
    store.append_once(events.filter("CAST(event_id AS BIGINT) % 3 > 0"), path)
    renamed = F.when(F.col("event_id").cast("bigint") % 7 == 0, F.concat(F.lit("n"), "event_id")).otherwise(F.col("event_id"))
    later = F.col("timestamp") + F.expr("INTERVAL 2 DAYS")
    for _ in range(2):
        store.append_once(events.withColumns({"event_id": renamed, "timestamp": later}), path)
    return _naive(tables.read_events(spark, path).select("event_id", "timestamp", "threat_score"))


def export_json(spark, sf_dir):
    path = scratch_dir(spark, "export")
    events = stored_events(spark, sf_dir)
    store.export_json(events, path)
    return _naive(spark.read.schema(events.schema).json(path).select("event_id", "timestamp", "path", "threat_score"))


def _rule_rows(spark, sf_dir):
    events = stored_events(spark, sf_dir)
    block = F.concat(F.lit("block-"), F.col("client_ip"))

    def rows(source, title, output, priority, enabled, *more):
        return source.select(
            block.alias("id"), F.lit(tables.SCORING_TYPE).alias("type"), title.alias("title"),
            F.lit("clientIp").alias("fact_key"), F.lit("EQUAL_TO").alias("operator"), F.col("client_ip").alias("operand"),
            output.alias("output"), priority.alias("priority"), enabled.alias("enabled"), *more,
        )

    clients = events.filter("action <> 'DENY'").select("client_ip").distinct()
    current = rows(clients, F.concat(F.lit("Block "), F.col("client_ip")), F.lit("50"), F.lit(5), F.lit(True))
    k = testdata.kind(F.col("request_size"))
    arrival = F.col("event_id").cast("bigint")
    changes = rows(
        events.filter("action = 'DENY'"), F.concat(F.lit("Event "), F.col("event_id")), k.cast("string"),
        (arrival % 100).cast("int"), k % 2 == 0, arrival.alias("change_order"),
    )
    return current, changes


def rules_upsert(spark, sf_dir):
    return rule_table.upsert_rules(*_rule_rows(spark, sf_dir))


def rules_delete(spark, sf_dir):
    current, _ = _rule_rows(spark, sf_dir)
    gone = stored_events(spark, sf_dir).filter(testdata.kind(F.col("request_size")) == 7)
    return rule_table.delete_rules(current, gone.select(F.concat(F.lit("block-"), F.col("client_ip")).alias("id")).distinct())


def rules_delete_all_stored(spark, sf_dir):
    """A stored rule table before and after all its rules were deleted."""
    path = scratch_dir(spark, "rules")
    rule_table.write_rules(_rule_rows(spark, sf_dir)[0], path)
    before = rule_table.load_rules(spark, path)
    rule_table.write_rules(rule_table.delete_rules(before, before.select("id")), path)
    counts = {"before": before, "after": rule_table.load_rules(spark, path)}
    before, after = (frame.agg(F.lit(name).alias("moment"), F.count(F.lit(1)).alias("rules")) for name, frame in counts.items())
    return before.unionByName(after)


def rules_edited_at_once(spark, sf_dir):
    """Two writers at the same moment: one changes rules whose id ends in an even digit, one deletes odd ones."""
    path = scratch_dir(spark, "rules")
    current, changes = _rule_rows(spark, sf_dir)
    rule_table.write_rules(current, path)
    even = F.substring("id", -1, 1).isin("0", "2", "4", "6", "8")
    gone = stored_events(spark, sf_dir).filter(testdata.kind(F.col("request_size")) == 7)
    gone = gone.select(F.concat(F.lit("block-"), F.col("client_ip")).alias("id")).filter(~even)
    with ThreadPoolExecutor(2) as writers:
        made = [writers.submit(rule_table.edit_rules, path, changes.filter(even)), writers.submit(rule_table.edit_rules, path, None, gone)]
        for edit in made:
            edit.result()
    return rule_table.load_rules(spark, path)


def rules_seed(spark, sf_dir):
    """Rules of another type do not count: the default rules are added to them."""
    others = _rule_rows(spark, sf_dir)[0].withColumn("type", F.lit("BLOCKING"))
    return rule_table.seed_rules(spark, others)


def rules_violations(spark, sf_dir):
    _, changes = _rule_rows(spark, sf_dir)
    broken = changes.withColumns(
        {
            "operator": F.when(F.col("priority") % 5 == 1, "LIKE").otherwise(F.col("operator")),
            "operand": F.when(F.col("priority") % 7 == 1, " \t ").otherwise(F.col("operand")),
        }
    )
    checked = rule_table.validate_rules(broken)
    return checked.select("id", "title", F.explode("violations.field").alias("field"))


# --- streams -------------------------------------------------------------------------------

DELIVERIES = 3


def _deliveries(spark, sf_dir):
    """Raw messages in log order, cut into a few deliveries."""
    raw = testdata.raw_events(spark, sf_dir).withColumn("payload", F.col("rawEvent"))
    messages = logs.raw_messages(_envelopes(raw))
    last = messages.agg(F.max("arrival")).first()[0]
    size = last // DELIVERIES + 1
    for i in range(DELIVERIES):
        part = messages.filter(F.col("arrival").between(i * size, (i + 1) * size - 1))
        # Each later delivery repeats the end of the one before; first sights are kept once.
        again = messages.filter(F.col("arrival").between(i * size - 50, i * size - 1))
        yield part if i == 0 else part.unionByName(again)


def _replay(messages: DataFrame) -> DataFrame:
    """Take the recorded receipt time instead of the trigger's clock."""
    return logs.good(logs.read_raw(messages)).select(
        "arrival", F.col("occurredAt").alias("received_at"), F.col("payload").alias("rawEvent")
    )


def _run(spark, sf_dir, label, start):
    """Deliver, run over what is there, stop; each run resumes from the checkpoint of the last."""
    base = scratch_dir(spark, label)
    for part in _deliveries(spark, sf_dir):
        logs.write_log(part, f"{base}/log")
        start(logs.read_folder(spark, f"{base}/log"), base).awaitTermination()
    return base


def stream_enrich(spark, sf_dir):
    rules = partial(tables.default_rules, spark)

    def start(log, base):
        return enrichment.start_enrichment(
            log, f"{base}/events", f"{base}/sightings", f"{base}/checkpoint", rules, _replay,
            ids_keep_their_day=True, available_now=True,
        )

    base = _run(spark, sf_dir, "stream-enrich", start)
    return tables.read_events(spark, f"{base}/events").select("event_id", "client_ip", "threat_score", "attack_type")


def stream_rule_edit(spark, sf_dir):
    """The stored rules change after the first delivery: one goes, one comes. Later batches score by the new ones."""
    base = scratch_dir(spark, "stream-rules")
    rule_table.write_rules(tables.default_rules(spark), f"{base}/rules")
    for i, part in enumerate(_deliveries(spark, sf_dir)):
        if i == 1:
            stored = rule_table.load_rules(spark, f"{base}/rules")
            left = rule_table.delete_rules(stored, stored.filter("id = 'severity-low'"))
            added = stored.filter("id = 'action-deny'").withColumns(
                {"id": F.lit("method-head"), "fact_key": F.lit("method"), "operand": F.lit("HEAD"), "output": F.lit("7"), "change_order": F.lit(1)}
            )
            rule_table.write_rules(rule_table.upsert_rules(left, added), f"{base}/rules")
        logs.write_log(part, f"{base}/log")
        enrichment.start_enrichment(
            logs.read_folder(spark, f"{base}/log"), f"{base}/events", f"{base}/sightings", f"{base}/checkpoint",
            lambda: rule_table.load_rules(spark, f"{base}/rules"), _replay, ids_keep_their_day=True, available_now=True,
        ).awaitTermination()
    return tables.read_events(spark, f"{base}/events").select("event_id", "threat_score")


def stream_all_stages(spark, sf_dir):
    """Request bodies to summary: ingest, write path and store, each a stream that reads what the one before wrote."""
    base = scratch_dir(spark, "stream-stages")
    logs.write_log(testdata.ingest_messages(spark, sf_dir), f"{base}/messages")
    gateway.start_ingest(
        logs.read_folder(spark, f"{base}/messages"), f"{base}/raw", f"{base}/refused", f"{base}/ingest-checkpoint", available_now=True
    ).awaitTermination()

    def publish(enriched: DataFrame, _: int) -> None:
        logs.write_log(logs.enriched_messages(logs.enriched_envelopes(enriched)), f"{base}/enriched")

    enrichment.start_enrichment(
        logs.read_folder(spark, f"{base}/raw"), f"{base}/events", f"{base}/sightings", f"{base}/checkpoint",
        partial(tables.default_rules, spark), publish=publish, available_now=True,
    ).awaitTermination()
    storing.start_store(
        logs.read_folder(spark, f"{base}/enriched"), f"{base}/stored", f"{base}/unread", f"{base}/store-checkpoint", available_now=True
    ).awaitTermination()
    return summary.summary(tables.read_events(spark, f"{base}/stored"))


def stream_store(spark, sf_dir):
    """The write path publishes what it scored; every fiftieth message is cut short on its way to the store stage."""
    base = scratch_dir(spark, "stream-store")
    logs.write_log(logs.raw_messages(_envelopes(testdata.raw_events(spark, sf_dir).withColumn("payload", F.col("rawEvent")))), f"{base}/log")

    def replay(messages: DataFrame) -> DataFrame:
        return enrichment.received(messages).withColumn("received_at", F.col("occurredAt"))

    def publish(enriched: DataFrame, _: int) -> None:
        sent = logs.enriched_messages(logs.enriched_envelopes(enriched))
        short = F.when(F.col("arrival") % 50 == 7, F.substring("value", 1, 40)).otherwise(F.col("value"))
        logs.write_log(sent.withColumn("value", short), f"{base}/enriched")

    enrichment.start_enrichment(
        logs.read_folder(spark, f"{base}/log"), f"{base}/events", f"{base}/sightings", f"{base}/checkpoint",
        partial(tables.default_rules, spark), replay, publish=publish, available_now=True,
    ).awaitTermination()
    storing.start_store(
        logs.read_folder(spark, f"{base}/enriched"), f"{base}/stored", f"{base}/refused", f"{base}/store-checkpoint", available_now=True
    ).awaitTermination()
    sent = spark.read.schema(MESSAGE).parquet(f"{base}/enriched").select("key", "correlation", "arrival")
    stored = tables.read_events(spark, f"{base}/stored").select("event_id", "threat_score", F.col("received_at").alias("occurred_at"))
    refused = spark.read.parquet(f"{base}/refused").select("arrival", F.lit(True).alias("refused"))
    told = sent.join(stored, F.col("arrival").cast("string") == F.col("event_id"), "left").join(refused, "arrival", "left")
    return _naive(told.select("arrival", "key", "correlation", "threat_score", "occurred_at", F.coalesce("refused", F.lit(False)).alias("refused")))


def stream_rejects(spark, sf_dir):
    """Every fiftieth raw message arrives cut short; the write path sets those aside."""
    base = scratch_dir(spark, "stream-rejects")
    whole = logs.raw_messages(_envelopes(testdata.raw_events(spark, sf_dir).withColumn("payload", F.col("rawEvent"))))
    short = F.when(F.col("arrival") % 50 == 7, F.substring("value", 1, 40)).otherwise(F.col("value"))
    logs.write_log(whole.withColumn("value", short), f"{base}/log")
    enrichment.start_enrichment(
        logs.read_folder(spark, f"{base}/log"), f"{base}/events", f"{base}/sightings", f"{base}/checkpoint",
        partial(tables.default_rules, spark), _replay, rejects_path=f"{base}/rejects", available_now=True,
    ).awaitTermination()
    return spark.read.parquet(f"{base}/rejects").select("arrival")


def _start_keyed(stream: DataFrame, base: str):
    writer = stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    return writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()


def stream_offender_count(spark, sf_dir):
    _use_rocksdb(spark)

    def start(log, base):
        events = _replay(log).select(client_ip().alias("client"), "received_at", "arrival", event_id().alias("event_id"))
        return _start_keyed(state.rolling_count(state.once_within_retention(events, "event_id")), base)

    base = _run(spark, sf_dir, "stream-count", start)
    return spark.read.parquet(f"{base}/out").select("arrival", F.col("offenderEventCount").alias("offender_count"))


def stream_quota(spark, sf_dir):
    _use_rocksdb(spark)
    base = scratch_dir(spark, "stream-quota")
    log = _quota_log(spark, sf_dir).select("client", "ts", "arrival")
    last = log.agg(F.max("arrival")).first()[0]
    size = last // DELIVERIES + 1
    for i in range(DELIVERIES):
        log.filter(F.col("arrival").between(i * size, (i + 1) * size - 1)).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{base}/log")
        _start_keyed(state.quota_stream(stream, 3, 60), base).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("arrival", "request_number", "allowed")


def _use_rocksdb(spark: SparkSession) -> None:
    for key, value in state.STATE_STORE.items():
        spark.conf.set(key, value)


def stream_ingest(spark, sf_dir):
    base = scratch_dir(spark, "stream-ingest")
    logs.write_log(testdata.ingest_messages(spark, sf_dir), f"{base}/log")
    log = logs.read_folder(spark, f"{base}/log")
    gateway.start_ingest(log, f"{base}/raw", f"{base}/rejects", f"{base}/checkpoint", available_now=True).awaitTermination()
    events = logs.good(logs.read_raw(spark.read.schema(MESSAGE).parquet(f"{base}/raw")))
    refused = spark.read.parquet(f"{base}/rejects")
    return events.select(F.lit("accepted").alias("outcome"), F.col("payload.eventId").alias("key")).unionByName(
        refused.select(F.lower("error_code").alias("outcome"), F.col("arrival").cast("string").alias("key"))
    )


def stream_timeseries(spark, sf_dir):
    base = scratch_dir(spark, "stream-series")
    store.write_events(stored_events(spark, sf_dir).withColumn("event_date", F.to_date("timestamp")), f"{base}/events")
    stream = spark.readStream.schema(tables.EVENTS).parquet(f"{base}/events")
    live.start_timeseries(stream, f"{base}/series", f"{base}/checkpoint", "1h", availableNow=True).awaitTermination()
    return _naive(live.read_timeseries(spark, f"{base}/series"))


def stream_alerts(spark, sf_dir):
    rules = partial(tables.default_rules, spark)
    alert_rules = partial(tables.alert_rules, spark, ALERT_RULES)

    def start(log, base):
        def report(evaluated: DataFrame, batch_id: int) -> None:
            evaluated.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/alerts")

        hook = live.alerts_after_batch(f"{base}/events", alert_rules, report, lambda: ALERTS_AS_OF)
        return enrichment.start_enrichment(
            log, f"{base}/events", f"{base}/sightings", f"{base}/checkpoint", rules, _replay,
            ids_keep_their_day=True, publish=hook, available_now=True,
        )

    base = _run(spark, sf_dir, "stream-alerts", start)
    reports = spark.read.parquet(f"{base}/alerts")
    newest = reports.agg(F.max("batch")).first()[0]
    return reports.filter(F.col("batch") == newest).select(*_ALERT_COLUMNS)


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "classify": classify,
        "facts_dotted": facts_dotted,
        "rule_first_match": rule_first_match,
        "matching_rules": matching_rules,
        "rule_hits": rule_hits,
        "threat_score": threat_score,
        "offender_count": partial(offender, False),
        "offender_count_millis": partial(offender, True),
        "first_sight": first_sights,
        "enrich": enriched_events,
        "enriched_summary": enriched_summary,
        "enriched_by_category": enriched_by_category,
        "stream_rejects": stream_rejects,
        "stream_store": stream_store,
        **{f"{name}_all": partial(over_all, question) for name, question in _UNFILTERED.items()},
        "total_events": partial(over_filtered, analytics.total_events),
        "by_category": partial(over_filtered, analytics.by_category),
        "by_action": partial(over_filtered, analytics.by_action),
        "top_attackers": partial(over_filtered, analytics.top_attackers),
        "top_paths": partial(over_filtered, analytics.top_paths),
        "summary": partial(over_filtered, summary.summary),
        "summary_document": partial(summary_document, _filtered),
        "summary_document_all": partial(summary_document, stored_events),
        "find_by_config": find_by_config,
        "count_all": count_all,
        "samples_page": samples_page,
        "samples_deep_page": samples_deep_page,
        "samples_total": samples_total,
        "samples_response": samples_response,
        "count_category_within": count_category_within,
        "alerts": evaluated_alerts,
        "alert_rules_stored": alert_rules_stored,
        "alert_rule_violations": alert_rule_violations,
        "quota_flags": quota_flags,
        "client_key": client_keys,
        "ingest_verdicts": ingest_verdicts,
        "ingest_violations": ingest_violations,
        "ingest_accepted": ingest_accepted,
        "ingest_rejected": ingest_rejected,
        "correlation": correlation,
        "raw_log": raw_log,
        "enriched_log": enriched_log,
        "flatten_roundtrip": flatten_roundtrip,
        "append_once": append_once,
        "append_changed_days": append_changed_days,
        "export_json": export_json,
        "rules_upsert": rules_upsert,
        "rules_delete": rules_delete,
        "rules_delete_all_stored": rules_delete_all_stored,
        "rules_edited_at_once": rules_edited_at_once,
        "rules_seed": rules_seed,
        "rules_violations": rules_violations,
        "stream_ingest": stream_ingest,
        "stream_enrich": stream_enrich,
        "stream_rule_edit": stream_rule_edit,
        "stream_all_stages": stream_all_stages,
        "stream_offender_count": stream_offender_count,
        "stream_quota": stream_quota,
        "stream_timeseries": stream_timeseries,
        "stream_alerts": stream_alerts,
        "rolled_page": rolled_page,
    }
    one = {"config_id": testdata.CONFIG_IDS[0], "start": FILTER_FROM, "end": FILTER_TO}
    within = {"category": "XSS", "start": FILTER_FROM, "end": FILTER_TO}
    rolled = {
        "by_category": (rollup.by_category, one),
        "by_category_all": (rollup.by_category, {}),
        "by_action": (rollup.by_action, one),
        "timeseries_1h": (rollup.timeseries, one),
        "count_category_within": (partial(rollup.total, name="event_count"), within),
    }
    for name, (question, conditions) in rolled.items():
        named[f"rolled_{name}"] = partial(rolled_question, question, conditions)
    for operator in RULE_CASES:
        named[f"rule_{operator.lower()}"] = partial(rule_predicate, operator)
    for label in ("1m", "5m", "1h"):
        named[f"timeseries_{label}"] = partial(over_filtered, partial(analytics.timeseries, interval=label))
    return named
