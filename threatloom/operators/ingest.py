"""Parsing, all-or-nothing validation and enveloping of ingest messages.

A message is one JSON object or an array of them. Everything up to the verdict stays inside
the message's row, so gating needs no shuffle; only accepted messages turn into event rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.functions.scalars import is_blank
from threatloom.schema import ACTIONS, CATEGORIES, ENVELOPE_VERSION, GEO, RAW_EVENT, RULE, SEVERITIES

# --- Fixed values: texts that callers compare -----------------------------------
MALFORMED = "MALFORMED_REQUEST"
INVALID = "VALIDATION_FAILED"
BLANK_MESSAGE = "must not be blank"
NULL_MESSAGE = "must not be null"
# ---------------------------------------------------------------------------------

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})$"
_VIOLATIONS = "array<struct<field:string,message:string>>"


def _all_text(schema: T.StructType) -> T.StructType:
    """The same fields as text, nested objects included: binding is judged afterwards."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


# A text value holds at most 2 GB and a valid item needs over 128 bytes, so 2^24 positions suffice.
POSITION_BITS = 24

_ITEMS = T.ArrayType(_all_text(RAW_EVENT))
_PARSED_RULE = "parsedRule"
_WRONG_KIND = "wrongKind"


def _whole(text: Column, kind: str) -> Column:
    """A whole number; a fraction is cut off, as the usual JSON binders do."""
    number = text.try_cast("decimal(38,9)")
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast(kind)


def _member(text: Column, allowed: list[str]) -> Column:
    """Present but outside the vocabulary."""
    return text.isNotNull() & ~text.isin(allowed)


def _instant(text: Column) -> Column:
    return F.when(text.rlike(_ISO), text.try_cast("timestamp"))


def _has_text(text: Column) -> Column:
    return ~is_blank(text)


def _does_not_bind(item: Column) -> Column:
    """A value is there but is not of the field's type."""
    rule = item[_PARSED_RULE]
    whole = [("configId", "int"), ("statusCode", "int"), ("requestSize", "bigint"), ("responseSize", "bigint")]
    wrong = item.isNull()
    for name, kind in whole:
        wrong = wrong | (_has_text(item[name]) & _whole(item[name], kind).isNull())
    return (
        wrong
        | (_has_text(item["timestamp"]) & _instant(item["timestamp"]).isNull())
        | _member(item["action"], ACTIONS)
        | F.coalesce(item[_WRONG_KIND], F.lit(False))
        | _member(rule["severity"], SEVERITIES)
        | _member(rule["category"], CATEGORIES)
    )


def _item_violations(item: Column, index: Column) -> Column:
    rule = item[_PARSED_RULE]

    def check(bad: Column, field: str, message: str) -> Column:
        path = F.concat(F.lit("["), index.cast("string"), F.lit(f"].{field}"))
        return F.when(bad, F.struct(path.alias("field"), F.lit(message).alias("message")))

    has_rule = item["rule"].isNotNull()
    checks = [
        check(is_blank(item["eventId"]), "eventId", BLANK_MESSAGE),
        check(is_blank(item["timestamp"]), "timestamp", NULL_MESSAGE),
        check(is_blank(item["clientIp"]), "clientIp", BLANK_MESSAGE),
        check(is_blank(item["path"]), "path", BLANK_MESSAGE),
        check(~has_rule, "rule", NULL_MESSAGE),
        check(has_rule & is_blank(rule["id"]), "rule.id", BLANK_MESSAGE),
        check(has_rule & is_blank(rule["name"]), "rule.name", BLANK_MESSAGE),
        check(has_rule & rule["severity"].isNull(), "rule.severity", NULL_MESSAGE),
        check(has_rule & rule["category"].isNull(), "rule.category", NULL_MESSAGE),
        check(item["action"].isNull(), "action", NULL_MESSAGE),
    ]
    return F.array_compact(F.array(*checks))


_TEXTS = [f"$.{f.name}" for f in RAW_EVENT.fields if f.dataType == T.StringType()] + [
    f"$.{f.name}.{inner.name}" for f in RAW_EVENT.fields if isinstance(f.dataType, T.StructType) for inner in f.dataType.fields
]
_OBJECTS = [f"$.{f.name}" for f in RAW_EVENT.fields if isinstance(f.dataType, T.StructType)]


def _wrong_kind(whole: Column) -> Column:
    """Whether an item, as a variant, has an object or array where a plain value belongs, or the reverse."""

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(whole, path, "variant")), F.lit("VOID"))

    wrong = F.lit(False)
    for path in _TEXTS:
        wrong = wrong | kind(path).rlike("^(OBJECT|ARRAY)<")
    for path in _OBJECTS:
        wrong = wrong | ~kind(path).rlike("^(OBJECT<|VOID$)")
    return wrong


def _opened(item: Column, whole: Column) -> Column:
    """The item with its rule parsed and its kinds judged beside it, once for all later uses."""
    fields = [item[name].alias(name) for name in RAW_EVENT.names]
    rule = F.from_json(item["rule"], _all_text(RULE)).alias(_PARSED_RULE)
    return F.when(item.isNotNull(), F.struct(*fields, rule, _wrong_kind(whole).alias(_WRONG_KIND)))


def check_messages(messages: DataFrame) -> DataFrame:
    """Add items, error_code, violations and accepted_count to each message.

    One value that does not bind, or a body that does not parse, makes the whole message
    malformed; otherwise one violation anywhere rejects all its items.
    """
    body = F.try_parse_json("value")
    lone = F.schema_of_variant(body).startswith("OBJECT")
    wholes = F.when(lone, F.array(body)).otherwise(F.try_variant_get(body, "$", "array<variant>"))
    read = messages.withColumns({"items": F.from_json("value", _ITEMS), "_wholes": wholes})
    # Pairing binds each variant to a variable; looked up by place, the body would be parsed again for every use.
    paired = F.coalesce("_wholes", F.array().cast("array<variant>"))
    parsed = read.withColumn("items", F.zip_with("items", paired, _opened)).drop("_wholes")
    # One walk over the items yields both answers.
    judged = parsed.withColumn(
        "_judged",
        F.transform(
            "items",
            lambda item, index: F.struct(
                _does_not_bind(item).alias("bad"), _item_violations(item, index).alias("violations")
            ),
        ),
    )
    malformed = F.col("items").isNull() | F.exists("_judged", lambda item: item["bad"])
    found = F.flatten(F.col("_judged")["violations"])
    told = judged.withColumn("_malformed", F.coalesce(malformed, F.lit(True))).withColumn(
        "violations", F.when(F.col("_malformed"), F.array().cast(_VIOLATIONS)).otherwise(found)
    )
    code = F.when(F.col("_malformed"), MALFORMED).when(F.size("violations") > 0, INVALID)
    return told.withColumn("error_code", code).withColumn(
        "accepted_count", F.when(F.col("error_code").isNull(), F.size("items")).otherwise(0)
    ).drop("_malformed", "_judged")


def correlation_id(header: Column, blank_counts: bool = False) -> Column:
    """The caller's id, or a new one; one per message, so take it before items are exploded.

    A request header must hold text to count, a message header (`blank_counts`) only bytes.
    """
    return F.coalesce(F.when(header != "" if blank_counts else header.rlike(r"\S"), header), F.uuid())


def _place(arrival: Column, position: Column) -> Column:
    """Log position and place in the message as one number; a log too long for that fails instead of wrapping round."""
    limit = 1 << (63 - POSITION_BITS)
    told = F.concat(F.lit("log position out of range: "), arrival.cast("string"))
    return F.when((arrival >= limit) | (arrival < -limit), F.raise_error(told).cast("bigint")).otherwise(
        F.shiftleft(arrival, POSITION_BITS) + position
    )


def to_raw_event(item: Column) -> Column:
    """Bind a checked item to the raw event; absent numbers are 0, an absent location stays null."""
    bound = {
        "timestamp": _instant(item["timestamp"]),
        "configId": F.coalesce(_whole(item["configId"], "int"), F.lit(0)),
        "statusCode": F.coalesce(_whole(item["statusCode"], "int"), F.lit(0)),
        "requestSize": F.coalesce(_whole(item["requestSize"], "bigint"), F.lit(0).cast("bigint")),
        "responseSize": F.coalesce(_whole(item["responseSize"], "bigint"), F.lit(0).cast("bigint")),
        "rule": item[_PARSED_RULE],
        "geoLocation": F.from_json(item["geoLocation"], GEO),
    }
    return F.struct(*[bound.get(name, item[name]).alias(name) for name in RAW_EVENT.names])


def accepted(checked: DataFrame, occurred_at: Column | None = None, blank_correlation_counts: bool = False) -> DataFrame:
    """Envelopes of the events of all accepted messages.

    `occurredAt` is one clock reading for all items of a message. `arrival` becomes a place
    in the log for each event: that of its message, and the position inside it in the low bits.
    """
    messages = checked.withColumns(
        {
            "correlationId": correlation_id(F.col("correlation"), blank_correlation_counts),
            "occurredAt": F.current_timestamp() if occurred_at is None else occurred_at,
        }
    )
    # A filter would move below the parsing and repeat it; an absent array yields no rows either.
    items = F.when(F.col("error_code").isNull(), F.col("items"))
    return messages.select("arrival", "correlationId", "occurredAt", F.posexplode(items).alias("position", "item")).select(
        _place(F.col("arrival"), F.col("position")).alias("arrival"),
        "position",
        "correlationId",
        "occurredAt",
        F.lit(ENVELOPE_VERSION).alias("version"),
        to_raw_event(F.col("item")).alias("payload"),
    )


def rejected(checked: DataFrame) -> DataFrame:
    """Messages that yield nothing, kept with the reason instead of being dropped."""
    reason = F.struct("error_code", "violations")
    return checked.select(
        "arrival", "value", "correlation", F.inline(F.when(F.col("error_code").isNotNull(), F.array(reason)))
    )
