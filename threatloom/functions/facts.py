"""Dotted-path facts: the value of `rule.severity`, `geoLocation.country`, … as text."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.scalars import iso_instant
from threatloom.schema import RAW_EVENT

OFFENDER_FACT = "offenderEventCount"


def fact_keys(schema: T.StructType = RAW_EVENT, prefix: str = "") -> list[str]:
    """Every key that names a leaf, in schema order, then the derived count."""
    keys: list[str] = []
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            keys += fact_keys(field.dataType, f"{prefix}{field.name}.")
        else:
            keys.append(prefix + field.name)
    return keys if prefix else [*keys, OFFENDER_FACT]


def _text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return iso_instant(value)
    if isinstance(kind, T.StructType):
        parts = [
            F.concat(F.lit(f"{f.name}="), F.coalesce(_text(value[f.name], f.dataType), F.lit("null")))
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    return value.cast("string")


@dataclass(frozen=True)
class Fact:
    """A value as text, and as a double where its declared type is a number."""

    text: Column
    number: Column | None = None


def fact(
    key: str,
    event: str = "rawEvent",
    schema: T.StructType = RAW_EVENT,
    offender_count: Column | None = None,
) -> Fact:
    """Resolve a key against the schema once, while planning.

    An unknown segment, or a segment below a plain value, is a typed null, so a rule on it
    costs nothing at run time.
    """
    missing = Fact(F.lit(None).cast("string"))
    if key == OFFENDER_FACT:
        return missing if offender_count is None else _as_fact(offender_count, T.LongType())
    segments = key.split(".")
    while len(segments) > 1 and segments[-1] == "":
        segments.pop()
    value, kind = F.col(event), schema
    for segment in segments:
        if not isinstance(kind, T.StructType) or segment not in kind.names:
            return missing
        value, kind = value[segment], kind[segment].dataType
    return _as_fact(value, kind)


def _as_fact(value: Column, kind: T.DataType) -> Fact:
    return Fact(_text(value, kind), value.cast("double") if isinstance(kind, T.NumericType) else None)
