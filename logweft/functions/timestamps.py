"""Timestamp parsing and printing (session time zone UTC)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# The month names in order.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH_RE = "|".join(MONTHS)

RFC3339_RE = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"
# What a bare DateTime parse also takes: 'T' or a blank, zone with or without colon.
LOOSE_RFC3339_RE = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?\s*(?:[Zz]|[+-]\d{2}:?\d{2})$"
NAIVE_RE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"
JSON_NAIVE_RE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?$"


def month_number(name: Column) -> Column:
    """1-12 for a three-letter month name, 0 for other text."""
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")


def utc(year: Column, month: Column, day: Column, clock: Column, fraction: Column | None = None) -> Column:
    """Timestamp of text pieces; NULL for an impossible date or time.

    A cast is used because Spark parses this layout without a formatter; digits
    beyond microseconds are cut.
    """
    parts = [year, F.lit("-"), month.cast("string"), F.lit("-"), F.ltrim(day), F.lit(" "), clock]
    if fraction is not None:
        parts += [F.lit("."), F.coalesce(fraction, F.lit(""))]
    return F.concat(*parts, F.lit("Z")).try_cast("timestamp")


def shift_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds * F.lit(1_000_000).cast("bigint"))


def fraction_micros(digits: Column) -> Column:
    """Leading digits of a fraction, cut or zero-padded to microseconds."""
    lead = F.regexp_extract(digits, r"^(\d{0,6})", 1)
    return F.rpad(lead, 6, "0").cast("int")


def _zoned(text: Column) -> Column:
    """Timestamp of ISO text that carries a zone (``+0900`` gets its colon)."""
    with_colon = F.regexp_replace(text, r"\s*([+-]\d{2})(\d{2})$", "$1:$2")
    return F.upper(with_colon).try_cast("timestamp")


# strftime directive -> (Java pattern, needs care)
_STRFTIME = {
    "Y": "yyyy",
    "m": "MM",
    "d": "dd",
    "e": "d",
    "H": "HH",
    "I": "hh",
    "M": "mm",
    "S": "ss",
    "p": "a",
    "b": "MMM",
    "B": "MMMM",
    "a": "EEE",
    "A": "EEEE",
    "y": "yy",
    "j": "DDD",
    "z": "xx",
    "F": "yyyy-MM-dd",
    "T": "HH:mm:ss",
    "D": "MM/dd/yy",
    "R": "HH:mm",
}


def java_pattern(fmt: str) -> str:
    """Java date pattern of a strftime format."""
    out, i = [], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            m = re.match(r"%(\.?\d?f)", fmt[i:])
            if m:
                body = m.group(1)
                width = int(re.sub(r"\D", "", body) or 9)
                dots = "." if body.startswith(".") else ""
                out.append(f"[{dots}{'S' * width}]" if body in (".f",) else f"{dots}{'S' * width}")
                i += len(m.group(0))
                continue
            code = fmt[i + 1] if i + 1 < len(fmt) else ""
            if code == "%":
                out.append("%")
            elif code in _STRFTIME:
                out.append(_STRFTIME[code])
            else:
                raise ValueError(f"unsupported directive %{code}")
            i += 2
            continue
        out.append("''" if ch == "'" else f"'{ch}'" if ch.isalpha() else ch)
        i += 1
    return "".join(out)


BSD_FORMATS = ("%b %e %H:%M:%S", "%b %d %H:%M:%S")


def parse_bsd_time(text: Column, year: Column) -> Column:
    """``Mon d HH:MM:SS`` with the year given (the day may be blank-padded)."""
    ok = text.rlike(rf"^(?:{MONTH_RE}).[ \d]\d.\d\d.\d\d.\d\d")
    ts = utc(
        year.cast("string"),
        month_number(F.substring(text, 1, 3)),
        F.substring(text, 5, 2),
        F.concat_ws(":", F.substring(text, 8, 2), F.substring(text, 11, 2), F.substring(text, 14, 2)),
    )
    return F.when(ok, ts)


def parse_ts(text: Column, fmt: str | None = None, year: Column | None = None) -> Column:
    """Timestamp of a text field; NULL when it does not parse.

    Without ``fmt``: ISO text with a zone, else ``Y-m-d H:M:S`` with blank or ``T``.
    """
    if fmt in BSD_FORMATS:
        return parse_bsd_time(text, year if year is not None else F.year(F.current_date()))
    if fmt is not None:
        lenient_day = fmt.replace("%d", "%e") if "%d" in fmt and "%b" in fmt else fmt
        squeezed = F.regexp_replace(text, " +", " ") if lenient_day != fmt else text
        return F.try_to_timestamp(squeezed, F.lit(java_pattern(lenient_day)))
    return (
        F.when(text.rlike(LOOSE_RFC3339_RE), _zoned(text))
        .when(text.rlike(NAIVE_RE), F.concat(text, F.lit("Z")).try_cast("timestamp"))
    )


def parse_json_ts(value: Column, is_text: Column, is_number: Column) -> Column:
    """Time of a JSON value: ISO text, ``Y-m-d H:M:S[.f]``, or epoch (above 1e12: ms)."""
    number = value.try_cast("double")
    # Whole seconds and the fraction go separately, as in the float they come from.
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("bigint")
    micros = whole * 1_000_000 + F.floor((number - whole) * 1_000_000_000 / 1000).cast("bigint")
    return (
        F.when(is_text & value.rlike(RFC3339_RE), _zoned(value))
        .when(is_text & value.rlike(JSON_NAIVE_RE), F.concat(value, F.lit("Z")).try_cast("timestamp"))
        .when(is_number & (number > 1e12) & (number < 9e15), F.timestamp_millis(whole))
        .when(is_number & (F.abs(number) <= 1e12), F.timestamp_micros(micros))
    )


def rfc3339(ts: Column) -> Column:
    """``2024-01-15T10:00:00+00:00`` with 0, 3 or 6 fraction digits as needed."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    )
    return F.concat(base, fraction, F.lit("+00:00"))


# Display styles of the viewer.
STYLES = {
    "seconds": "yyyy-MM-dd HH:mm:ss",
    "millis": "yyyy-MM-dd HH:mm:ss.SSS",
    "clock": "HH:mm:ss",
}


def fmt_ts(ts: Column, style: str = "seconds") -> Column:
    return F.date_format(ts, STYLES[style])
