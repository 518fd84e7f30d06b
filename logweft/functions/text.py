"""Templates, counts and JSON text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_FIELD = re.compile(r"\{([^{}]*)\}")


def render(template: str, values: Column) -> Column:
    """Fill ``{field}`` from a map column; an unknown field stays as it is."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(F.coalesce(F.try_element_at(values, F.lit(m.group(1))), F.lit(m.group(0))))
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def fmt_count(c: Column) -> Column:
    """``1,234,567``."""
    return F.format_number(c, 0)


# Beyond 64 bits whole numbers are told as doubles.
_MAX_U64 = "18446744073709551615"
# Containers inside containers are printed number by number down to this depth, deeper ones as they are stored.
_NUMBER_DEPTH = 2


def float_text(d: Column) -> Column:
    """Shortest text of a double that reads back the same: ``1.0``, ``0.00001``, ``1e16``, ``1.5e-7``."""
    text, size = d.cast("string"), F.abs(d)
    plain = F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    return (
        F.when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e-5) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), F.substring_index(text, "E", -1)))
    )


def number_text(v: Column) -> Column:
    """Text of a VARIANT number: whole numbers as digits, those written with a point or exponent as doubles."""
    kind, json = F.schema_of_variant(v), F.to_json(v)
    # A whole decimal is either beyond 63 bits or was written with a point.
    big = json.cast("decimal(38,0)").between(F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit(_MAX_U64).cast("decimal(38,0)"))
    whole = kind.endswith(",0)") & big
    return F.when((kind == "BIGINT") | whole, json).otherwise(float_text(F.try_variant_get(v, "$", "double")))


def json_of(v: Column, depth: int = _NUMBER_DEPTH) -> Column:
    """JSON of a VARIANT with its numbers as in ``number_text``."""
    json = F.to_json(v)
    first = F.substring(json, 1, 1)
    out = F.when(first.isin(*"-0123456789"), number_text(v))
    if depth:
        members = F.transform(
            F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")),
            lambda e: F.concat(_quoted(e["key"]), F.lit(":"), json_of(e["value"], depth - 1)),
        )
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: json_of(x, depth - 1))
        out = out.when(first == "{", F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
        out = out.when(first == "[", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
    return out.otherwise(json)


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def json_text(v: Column) -> Column:
    """Text of a VARIANT: strings bare, null as ``null``, the rest as JSON."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "VOID", F.lit("null"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .otherwise(json_of(v))
    )
