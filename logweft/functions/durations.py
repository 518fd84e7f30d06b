"""Duration text to milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_WHOLE = r"^\s*(?:\d+(?:ms|s|m|h|d))+\s*$"
_LIMIT = 9_223_372_036_854_775_807


def parse_duration(c: Column) -> Column:
    """Milliseconds of ``500ms``, ``30s``, ``1h30m``…; NULL when bad, overflowing or not positive."""
    numbers = F.regexp_extract_all(c, F.lit(r"(\d+)(ms|s|m|h|d)"), F.lit(1))
    units = F.regexp_extract_all(c, F.lit(r"(\d+)(ms|s|m|h|d)"), F.lit(2))

    def to_ms(n: Column, u: Column) -> Column:
        scale = F.lit(None).cast("bigint")
        for unit, ms in _UNIT_MS.items():
            scale = F.when(u == unit, F.lit(ms).cast("bigint")).otherwise(scale)
        return F.try_multiply(n.try_cast("bigint"), scale)

    total = F.aggregate(F.zip_with(numbers, units, to_ms), F.lit(0).cast("bigint"), F.try_add)
    return F.when(c.rlike(_WHOLE) & (total > 0), total)


def duration_ms(text: str) -> int:
    """The same rule for a value the caller gives (``"5m"``); error when bad."""
    import re

    if not re.match(_WHOLE, text):
        raise ValueError(f"bad duration {text!r}")
    total = sum(int(n) * _UNIT_MS[u] for n, u in re.findall(r"(\d+)(ms|s|m|h|d)", text))
    if not 0 < total <= _LIMIT:
        raise ValueError(f"bad duration {text!r}")
    return total


def timeout_seconds(text: str) -> int:
    """Rule timeout ``Ns``, ``Nm`` or ``Nh``."""
    text = text.strip()
    scale = {"s": 1, "m": 60, "h": 3600}.get(text[-1:])
    number = text[:-1].strip()
    if scale is None or not number.isdigit():
        raise ValueError(f"bad timeout {text!r}")
    return int(number) * scale


def fmt_duration(ms: Column) -> Column:
    """``250ms``, ``1.5s``, ``2m5s``; negative prints as ``0ms``."""
    text = lambda c: c.cast("string")
    return (
        F.when(ms < 0, F.lit("0ms"))
        .when(ms < 1000, F.concat(text(ms), F.lit("ms")))
        .when(ms < 60_000, F.format_string("%.1fs", F.bround(ms / F.lit(1000.0), 1)))
        .otherwise(
            F.concat(text(F.floor(ms / 60_000)), F.lit("m"), text(F.floor((ms % 60_000) / 1000)), F.lit("s"))
        )
    )


def fmt_exact(seconds: Column) -> Column:
    """Seconds in the largest unit that divides them: ``2d``, ``3h``, ``5m``, ``7s``."""
    a = F.abs(seconds)
    whole = lambda n, unit: F.concat((a / n).cast("bigint").cast("string"), F.lit(unit))
    return (
        F.when((a >= 86_400) & (a % 86_400 == 0), whole(86_400, "d"))
        .when((a >= 3_600) & (a % 3_600 == 0), whole(3_600, "h"))
        .when((a >= 60) & (a % 60 == 0), whole(60, "m"))
        .otherwise(whole(1, "s"))
    )


def fmt_open(ms: Column) -> Column:
    """Form of a region that timed out: ``>12s``."""
    return F.concat(F.lit(">"), (ms / 1000).cast("bigint").cast("string"), F.lit("s"))
