"""Enrichment: first sight, rolling count, score and attack type."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.scalars import attack_type
from threatloom.operators.scoring import compile_rules, threat_score
from threatloom.operators.windows import STRETCH, first_sight, offender_count


def event_id() -> Column:
    return F.col("rawEvent.eventId")


def client_ip() -> Column:
    return F.col("rawEvent.clientIp")


def sightings(raw: DataFrame) -> DataFrame:
    """The few columns that de-duplication and counting need."""
    return raw.select(event_id().alias("event_id"), client_ip().alias("client"), "received_at", "arrival")


def attach_counts(raw: DataFrame, counted: DataFrame) -> DataFrame:
    """Bring offenderEventCount to the events; events without a counted sighting drop out.

    The log position is part of the key, so many copies of one id spread over tasks, and this
    is the only time whole events are shuffled.
    """
    counts = counted.select(
        F.col("event_id").alias("_id"), F.col("client").alias("_client"), F.col("arrival").alias("_arrival"), "offenderEventCount"
    )
    same = (event_id() == F.col("_id")) & client_ip().eqNullSafe(F.col("_client")) & (F.col("arrival") == F.col("_arrival"))
    return raw.join(counts, same).drop("_id", "_client", "_arrival")


def score_events(counted: DataFrame, rules: DataFrame) -> DataFrame:
    """Add attackType, threatScore and receivedAt to rows that carry offenderEventCount."""
    compiled = compile_rules(rules, offender_count=F.col("offenderEventCount"))
    return counted.select(
        "*",
        attack_type(F.col("rawEvent.rule.category")).alias("attackType"),
        threat_score(compiled).alias("threatScore"),
        F.col("received_at").alias("receivedAt"),
    )


def enrich(raw: DataFrame, rules: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(arrival, received_at, rawEvent) -> the same rows, once per id, scored and classified.

    Copies are dropped before counting, so a redelivery never raises a client's count.
    `arrival` is unique per client; `stretch` is how much of it is counted as one point, so
    widen it (`STRETCH << POSITION_BITS`) where `arrival` comes straight from `ingest.accepted`.
    """
    once = first_sight(sightings(raw), F.col("event_id"))
    counted = offender_count(once, F.col("client"), F.col("received_at"), stretch=stretch)
    return score_events(attach_counts(raw, counted), rules)
