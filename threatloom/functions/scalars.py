"""Scalar helpers shared by the operators."""

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from threatloom.schema import ATTACK_TYPES


def is_blank(text: Column) -> Column:
    """True for null, empty, or nothing but spaces and control characters."""
    return text.isNull() | ~text.rlike(r"[^\x00-\x20]")


def trimmed(text: Column) -> Column:
    """Strip spaces and control characters from both ends (`trim` alone strips spaces only)."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def attack_type(category: Column) -> Column:
    """Display name of a category; null for anything outside the vocabulary."""
    pairs = [F.lit(part) for pair in ATTACK_TYPES.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), category)


def instant(value: datetime | str | Column) -> Column:
    """A timestamp literal; text and datetimes without a zone are UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat() + "Z"
    return F.lit(value).cast("timestamp")


def floor_div(value: Column, width: int) -> Column:
    """Whole-number division rounding down, exact for the full 64-bit range."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def round1(value: Column) -> Column:
    """One decimal, halves upward."""
    return F.floor(value * 10 + 0.5) / 10


def clamp_score(points: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), points)).cast("int")


def iso_instant(instant: Column) -> Column:
    """ISO-8601 text in UTC with no fraction, 3 digits or 6 digits, whichever is shortest."""
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    fraction = (
        F.when(micros == 0, "")
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("bigint").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    )
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def client_key(forwarded_for: Column, remote_addr: Column) -> Column:
    """First hop of a forwarding header; the peer address only where the header is blank."""
    return F.when(is_blank(forwarded_for), remote_addr).otherwise(
        trimmed(F.split(forwarded_for, ",", 2).getItem(0))
    )
