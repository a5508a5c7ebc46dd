"""The fifteen rule predicates, each compiled to one boolean Column.

The operand is known while planning, so its parsing (numbers, token lists, pattern checks)
happens once on the driver and the executors see only built-in expressions.
"""

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.facts import Fact

_BLANKS = "".join(map(chr, range(0x21)))
_DECIMAL = re.compile(r"[+-]?(NaN|Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?)", re.ASCII)
_HEX = re.compile(r"[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+[fFdD]?", re.ASCII)
# The SQL cast also reads these words in any case; only the exact spellings are numbers here.
_LOOSE_WORDS = r"(?i)^[\x00-\x20]*[+-]?(inf|infinity|nan)[\x00-\x20]*$"
_EXACT_WORDS = r"^[\x00-\x20]*[+-]?(Infinity|NaN)[\x00-\x20]*$"


def parse_number(text: str) -> float | None:
    """A double by the JVM's literal grammar, or None."""
    text = text.strip(_BLANKS)
    if _DECIMAL.fullmatch(text):
        return float(text.rstrip("fFdD") if text[-1] in "fFdD" else text)
    if _HEX.fullmatch(text):
        return float.fromhex(text.rstrip("fFdD") if re.search(r"[pP][+-]?\d+[fFdD]$", text) else text)
    return None


def as_number(value: Fact) -> Column:
    if value.number is not None:
        return value.number
    number = value.text.try_cast("double")
    special = F.isnan(number) | (F.abs(number) == float("inf"))
    wrong_word = value.text.rlike(_LOOSE_WORDS) & ~value.text.rlike(_EXACT_WORDS)
    return F.when(special & wrong_word, None).otherwise(number)


def tokens(operand: str) -> list[str]:
    """Comma-separated words, trimmed; empty words at the end do not count."""
    parts = operand.split(",")
    while len(parts) > 1 and parts[-1] == "":
        parts.pop()
    if parts == [""] and operand:
        return []
    return [part.strip(_BLANKS) for part in parts]


def _compare(value: Fact, operand: str, test) -> Column:
    """Numbers when both sides are numbers, text otherwise."""
    number = parse_number(operand)
    as_text = test(value.text, F.lit(operand))
    if number is None:
        return as_text
    as_double = test(as_number(value), F.lit(number))
    if value.number is not None:
        return as_double
    return F.when(as_number(value).isNotNull(), as_double).otherwise(as_text)


def _any_of(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _full_match(value: Column, pattern: str) -> Column:
    """Java's whole-text match. An unusable pattern matches nothing.

    Anchors put around a pattern end up inside it if it leaves a quote open or ends in a
    comment; then the group does not close, and one of the other forms ends both first.
    """
    forms = (rf"\A(?:{pattern}{end})\z" for end in ("", r"\E", "\n"))
    usable = next(filter(_compiles, forms), None) if _compiles(pattern) else None
    return F.lit(False) if usable is None else value.rlike(usable)


def _compiles(pattern: str) -> bool:
    """Folded on the driver, no job."""
    try:
        SparkSession.active().sql("SELECT '' RLIKE :pattern AS ok", args={"pattern": pattern}).collect()
    except PySparkException:
        return False
    return True


def _between(value: Fact, operand: str) -> Column:
    bounds = [parse_number(token) for token in tokens(operand)]
    if len(bounds) != 2 or any(bound is None or bound != bound for bound in bounds):
        return F.lit(False)
    number = as_number(value)
    return ~F.isnan(number) & number.between(*bounds)


def _in(value: Fact, operand: str) -> Column:
    words = tokens(operand)
    return value.text.isin(words) if words else F.lit(False)


_TESTS = {
    "EQUAL_TO": lambda v, x: _compare(v, x, lambda a, b: a == b),
    "NOT_EQUAL_TO": lambda v, x: _compare(v, x, lambda a, b: a != b),
    "GREATER_THAN": lambda v, x: _compare(v, x, lambda a, b: a > b),
    "GREATER_THAN_OR_EQUAL": lambda v, x: _compare(v, x, lambda a, b: a >= b),
    "LESS_THAN": lambda v, x: _compare(v, x, lambda a, b: a < b),
    "LESS_THAN_OR_EQUAL": lambda v, x: _compare(v, x, lambda a, b: a <= b),
    "IN": _in,
    "NOT_IN": lambda v, x: v.text.isNotNull() & ~_in(v, x),
    "CONTAINS": lambda v, x: v.text.contains(x),
    "CONTAINS_ANY": lambda v, x: _any_of([v.text.contains(word) for word in tokens(x)]),
    "STARTS_WITH": lambda v, x: v.text.startswith(x),
    "ENDS_WITH": lambda v, x: v.text.endswith(x),
    "REGEX_MATCH": lambda v, x: _full_match(v.text, x),
    "BETWEEN": _between,
    "EXISTS": lambda v, x: v.text.isNotNull() if x.lower() == "true" else v.text.isNull(),
}

OPERATORS = list(_TESTS)


def predicate(value: Fact, operator: str, operand: str) -> Column:
    """True or false, never null: a missing fact fails everything but EXISTS."""
    if operator not in _TESTS:
        raise ValueError(f"invalid operator: {operator}; known are {', '.join(OPERATORS)}")
    return F.coalesce(_TESTS[operator](value, operand), F.lit(False))
