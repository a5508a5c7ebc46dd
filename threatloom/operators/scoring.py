"""Rule evaluation: rows of the rule table become one expression over the event.

Rules are a small, human-edited table. They are read once and compiled, so scoring adds no
join, no shuffle and no Python to the plan.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.facts import fact
from threatloom.functions.predicates import predicate
from threatloom.functions.scalars import clamp_score
from threatloom.sources.tables import read_rules


@dataclass(frozen=True)
class CompiledRule:
    id: str
    points: int
    matches: Column


def compile_rules(
    rules: DataFrame,
    event: str = "rawEvent",
    offender_count: Column | None = None,
    rule_type: str = "SCORING",
) -> list[CompiledRule]:
    """Enabled rules in priority order, each with its condition as a boolean Column."""
    rows = read_rules(rules, rule_type=rule_type, ordered=False).collect()
    return [
        CompiledRule(
            row["id"],
            int(row["output"]),
            predicate(fact(row["fact_key"], event, offender_count=offender_count), row["operator"], row["operand"]),
        )
        for row in sorted(rows, key=lambda row: (row["priority"], row["id"]))
    ]


def _sum(columns: list[Column]) -> Column:
    """Balanced, so that hundreds of rules do not nest hundreds deep."""
    if not columns:
        return F.lit(0)
    if len(columns) == 1:
        return columns[0]
    half = len(columns) // 2
    return _sum(columns[:half]) + _sum(columns[half:])


def threat_score(rules: list[CompiledRule]) -> Column:
    return clamp_score(_sum([F.when(rule.matches, rule.points).otherwise(0) for rule in rules]))


def matching_rules(rules: list[CompiledRule]) -> Column:
    """Array of (id, points) of all matching rules, in priority order."""
    found = [F.when(r.matches, F.struct(F.lit(r.id).alias("id"), F.lit(r.points).alias("points"))) for r in rules]
    if not found:
        return F.array().cast("array<struct<id:string,points:int>>")
    return F.array_compact(F.array(*found))


def first_match(rules: list[CompiledRule]) -> Column:
    """Id of the matching rule that comes first by priority; null without a match."""
    if not rules:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(rule.matches, rule.id) for rule in rules])


def rule_hits(events: DataFrame, rules: list[CompiledRule]) -> DataFrame:
    """(rule_id, hits) for every rule, zero included.

    One conditional count per rule: a single aggregation row leaves each task, however many
    events match.
    """
    schema = "rule_id string, hits long"
    if not rules:
        return events.sparkSession.createDataFrame([], schema)
    counts = events.agg(*[F.count_if(rule.matches).alias(f"r{i}") for i, rule in enumerate(rules)])
    pairs = [F.struct(F.lit(rule.id).alias("rule_id"), F.col(f"r{i}").alias("hits")) for i, rule in enumerate(rules)]
    return counts.select(F.inline(F.array(*pairs)))
