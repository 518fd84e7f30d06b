"""Predicates on log fields as Columns.

A comparison on a missing field is false (also ``!=``), so ``~`` of it is true:
every comparison is made two-valued at the leaf and AND / OR / NOT are plain
Column operators. Numeric and time columns are compared typed where the result
is the same, so that the test reaches the parquet scan.
"""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.regex import search, translate
from ..functions.timestamps import RFC3339_RE, rfc3339
from ..schema import LOG_SCHEMA

# Names of the log fields.
TEXT_FIELDS = (
    "level", "source", "component_name", "process_name", "hostname", "container", "context", "function", "message", "raw", "loader_id",
)
NUMBER_FIELDS = ("id", "pid", "tid")
ALIASES = {"component": "component_name", "process": "process_name"}

ORDERED = (">", ">=", "<", "<=")
OPERATORS = ("==", "!=", *ORDERED, "contains", "starts_with", "ends_with", "regex")

_NUMBER = re.compile(r"[+-]?(?:inf|infinity|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\Z", re.I | re.A)
_NUMBER_RLIKE = r"(?i)^[+-]?(?:inf|infinity|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)\z"


def field(name: str) -> Column:
    """Column of a field; unknown names are looked up in the metadata."""
    name = ALIASES.get(name, name)
    if name in TEXT_FIELDS or name in NUMBER_FIELDS or name == "timestamp":
        return F.col(name)
    key = name[len("metadata.") :] if name.startswith("metadata.") else name
    return F.try_element_at(F.col("metadata"), F.lit(key))


def field_text(name: str) -> Column:
    """The field as the text that comparisons see."""
    c = field(name)
    if name == "timestamp":
        return rfc3339(c)
    return c.cast("string") if name in NUMBER_FIELDS else c


def _order(left: Column, op: str, right: Column) -> Column:
    return {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]


def cmp_num_or_text(text: Column, op: str, value: str) -> Column:
    """Ordered comparison: by number when both sides are numbers, else by bytes."""
    as_text = _order(text, op, F.lit(value))
    if not _NUMBER.match(value):
        return as_text
    as_number = _order(text.try_cast("double"), op, F.lit(float(value)))
    return F.when(text.rlike(_NUMBER_RLIKE), as_number).otherwise(as_text)


def log_cmp(name: str, op: str, value) -> Column:
    """``field op value``; never NULL."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    value = str(value)
    if op == "regex":
        try:
            return F.coalesce(search(field_text(name), value), F.lit(False))
        except ValueError:
            return F.lit(False)
    typed = _typed(name, op, value)
    if typed is not None:
        return F.coalesce(typed, F.lit(False))
    c = field_text(name)
    test = {
        "==": lambda: c == value,
        "!=": lambda: c != value,
        "contains": lambda: c.contains(value),
        "starts_with": lambda: c.startswith(value),
        "ends_with": lambda: c.endswith(value),
    }.get(op, lambda: cmp_num_or_text(c, op, value))()
    return F.coalesce(test, F.lit(False))


def _typed(name: str, op: str, value: str) -> Column | None:
    """Comparison on the stored type, when it equals the text comparison."""
    if op not in ("==", "!=", *ORDERED):
        return None
    if name in NUMBER_FIELDS:
        canonical = re.fullmatch(r"0|-?[1-9]\d{0,17}", value)
        if op in ORDERED and _NUMBER.match(value):
            number = float(value)
            if canonical or (number.is_integer() and abs(number) < 2**53):
                return _order(F.col(name), op, F.lit(int(value) if canonical else int(number)).cast("bigint"))
            return _order(F.col(name).cast("double"), op, F.lit(number))
        if op in ("==", "!=") and canonical:
            same = F.col(name) == F.lit(int(value)).cast("bigint")
            return same if op == "==" else ~same
        return None
    if name == "timestamp" and re.match(RFC3339_RE, value):
        moment = F.lit(value.upper()).cast("timestamp")
        if op in ("==", "!="):
            return F.col(name) == moment if op == "==" else F.col(name) != moment
        return _order(F.col(name), op, moment)
    return None


def all_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True)) if len(preds) != 1 else preds[0]


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def predicate(spec) -> Column:
    """Column of a rule's predicate.

    Accepts a Column, Spark SQL boolean text, ``{field, op, value}``, or
    ``{all: […]}``, ``{any: […]}``, ``{not: …}`` around them.
    """
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, str):
        return F.coalesce(F.expr(spec), F.lit(False))
    if "all" in spec:
        return all_of([predicate(s) for s in spec["all"]])
    if "any" in spec:
        return any_of([predicate(s) for s in spec["any"]])
    if "not" in spec:
        return ~predicate(spec["not"])
    if spec.get("op") == "regex":
        translate(str(spec["value"]))
    return log_cmp(spec["field"], spec["op"], spec["value"])


def check_predicate(spark: SparkSession, spec) -> Column:
    """``predicate`` tested against the log schema; raises ValueError when it is unusable."""
    try:
        c = predicate(spec)
        spark.createDataFrame([], LOG_SCHEMA).filter(c).schema
        return c
    except (AnalysisException, KeyError, TypeError, ValueError) as e:
        raise ValueError(f"bad predicate {spec!r}: {e}") from e
    except Exception as e:
        if type(e).__name__ in ("ParseException", "IllegalArgumentException"):
            raise ValueError(f"bad predicate {spec!r}: {e}") from e
        raise


def usable_predicates(spark: SparkSession, specs: list, what: str) -> list[tuple[int, Column]]:
    """(position, Column) of the predicates that are fine; the others warn and are left out."""
    kept = []
    for i, spec in enumerate(specs):
        try:
            kept.append((i, check_predicate(spark, spec)))
        except ValueError as e:
            warnings.warn(f"{what} skipped: {e}", stacklevel=2)
    return kept
