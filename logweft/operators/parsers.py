"""Parsers: a line becomes a struct of log fields, or NULL when it is not that format.

A parser works in stages so that the expensive ones (a regex, JSON decoding) are
computed once and then only referred to: each stage takes the result of the one
before, starting with the line; ``build`` makes the struct of the last result.
``parse_*`` functions compose them in one Column; ``chain.parse_chain`` gives each
stage a projection of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions.levels import normalize_level
from ..functions.regex import captures, matched, translate, whole
from ..functions.timestamps import month_number, parse_ts, shift_seconds, utc
from ..schema import PARSED_TYPE

MAX_U32 = 4_294_967_295
MAX_TEXT = 2_147_483_647


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class Parser:
    name: str
    stages: tuple[Callable[[Column, Column], Column], ...]  # (stage before, year)
    build: Callable[[Column, Column, Column], Column]  # (last stage, line, year)

    def __call__(self, line: Column, year: Column | None = None) -> Column:
        def step(value: Column, left: tuple) -> Column:
            if not left:
                return self.build(value, line, _year(year))
            return let(left[0](value, _year(year)), lambda v: step(v, left[1:]))

        return step(line, self.stages)


def _year(year) -> Column:
    return F.lit(None).cast("int") if year is None else year if isinstance(year, Column) else F.lit(year)


def parsed(**fields: Column) -> Column:
    """Struct of all log fields; those not given are NULL."""
    return F.struct(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PARSED_TYPE.fields]
    )


def before(c: Column, sep: str) -> Column:
    """Text before the first ``sep`` (all of it when absent)."""
    return F.substring_index(c, sep, 1)


def after(c: Column, sep: str) -> Column:
    """Text after the first ``sep`` ('' when absent)."""
    return F.when(F.contains(c, F.lit(sep)), F.substr(c, F.instr(c, sep) + len(sep))).otherwise(F.lit(""))


def has(c: Column, sep: str) -> Column:
    return F.contains(c, F.lit(sep))


def u32(text: Column) -> Column:
    """Number of a text of ASCII digits; NULL when it is none or beyond 32 bits."""
    n = F.when(text.rlike(r"^\+?[0-9]+\z"), text.try_cast("bigint"))
    return F.when(n <= MAX_U32, n)


# ---------------------------------------------------------------- syslog


def _process_fields(part: Column) -> tuple[Column, Column, Column]:
    container = F.when(has(part, "#"), before(part, "#"))
    rest = F.when(has(part, "#"), after(part, "#")).otherwise(part)
    digits = before(F.substring_index(rest, "[", -1), "]")
    # Between two zeros only digits give a number (no sign, no blanks); nothing gives 0.
    number = F.concat(F.lit("0"), digits, F.lit("0")).try_cast("bigint") / 10
    pid = F.when(has(rest, "["), number.cast("bigint"))
    return container, before(rest, "["), F.when(pid <= MAX_U32, pid)


def split_process(part: Column) -> Column:
    """Struct ``container, process_name, pid`` of ``container#process[pid]``."""
    container, process, pid = _process_fields(part)
    return F.struct(container.alias("container"), process.alias("process_name"), pid.alias("pid"))


_CLOCK = r"\d\d:\d\d:\d\d"
_TAIL = r"([^ ]*) (.*?): (.*)\z"
_ZONE = r"(Z|[+-]\d\d:?\d\d)?"
# Blank instead of T, and a reception time before the event time.
_PRECISE = (
    rf"(?s)\A(?:\d{{4}}-\d\d-\d\d[T ]{_CLOCK}(?:\.\d*)?(?:Z|[+-]\d\d:?\d\d)? )?"
    rf"(\d{{4}})-(\d\d)-(\d\d)[T ]({_CLOCK})(?:\.(\d*))?{_ZONE} {_TAIL}"
)

_PRECISE_LAYOUT: list[int | str] = [1, 2, 3, 4, 5, 6, 7, 8, 9]
_ISO_STAMP = rf"\A(\d{{4}}-\d\d-\d\d)T({_CLOCK}(?:\.\d*)?){_ZONE}\z"


def _words(line: Column, layouts: str, precise: bool) -> Column:
    """The blank-separated front of a line: ``layout, date, clock, zone, host, level, process and message``.

    Fixed positions and one split; only the few characters of the time see a regex.
    """
    digit = F.substring(line, 1, 1).between("0", "9")
    fifth = F.substring(line, 5, 1)
    none = F.lit("")
    out = F.when(F.lit(False), F.array(none))
    if "B" in layouts:
        w = F.split(F.substring(line, 8, MAX_TEXT), " ", 3)
        front = F.substring(line, 1, 7)
        ascii_front = F.octet_length(front) == 7
        out = out.when(
            F.substring(line, 1, 1).between("A", "Z") & ascii_front,
            F.concat(F.array(F.lit("B"), front), F.slice(w, 1, 1), F.array(none), F.slice(w, 2, 1), F.array(none), F.slice(w, 3, 1)),
        )
    if "E" in layouts:
        w = F.split(F.substring(line, 13, MAX_TEXT), " ", 4)
        out = out.when(
            digit & (fifth == " ") & (F.octet_length(line) >= 30) & (F.substring(line, 9, 1) == " ") & (F.substring(line, 12, 1) == " "),
            F.concat(F.array(F.lit("E"), F.substring(line, 1, 11)), F.slice(w, 1, 1), F.array(none), F.slice(w, 2, 3)),
        )
    if "I" in layouts and precise:
        caps = captures(line, _PRECISE, _PRECISE_LAYOUT)
        stamp = F.concat_ws("-", F.slice(caps, 2, 3))
        clock = F.concat(caps[4], F.lit("."), caps[5])
        tail = F.concat(caps[8], F.lit(": "), caps[9])
        whole_line = F.when(
            matched(caps, _PRECISE_LAYOUT), F.array(F.lit("I"), stamp, clock, caps[6], caps[7], none, tail)
        )
        out = out.when(digit & (fifth == "-"), whole_line)
    elif "I" in layouts:
        w = F.split(line, " ", 3)
        part = lambda i: F.regexp_extract(w[0], _ISO_STAMP, i)
        out = out.when(
            digit & (fifth == "-"),
            F.concat(F.array(F.lit("I"), part(1), part(2), part(3)), F.slice(w, 2, 1), F.array(none), F.slice(w, 3, 1)),
        )
    return out


def _syslog_time(w: Column, year: Column) -> Column:
    kind, date, clock, zone = w[0], w[1], w[2], w[3]
    bsd = kind == "B"
    month = month_number(F.when(bsd, F.substring(date, 1, 3)).otherwise(F.substring(date, 6, 3)))
    named = F.concat(
        F.when(bsd, year.cast("string")).otherwise(F.substring(date, 1, 4)),
        F.lit("-"),
        month.cast("string"),
        F.lit("-"),
        F.ltrim(F.when(bsd, F.substring(date, 5, 2)).otherwise(F.substring(date, 10, 2))),
    )
    text = F.when(kind == "I", date).when(month > 0, named)
    # The cast checks digits and ranges; the places of the colons are fixed.
    placed = (F.substring(clock, 3, 1) == ":") & (F.substring(clock, 6, 1) == ":")
    ended = (F.length(clock) == 8) | (~bsd & (F.substring(clock, 9, 1) == "."))
    at = F.when(placed & ended, F.concat(text, F.lit(" "), clock, F.lit("Z")).try_cast("timestamp"))
    hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.right(zone, F.lit(2)).try_cast("int")
    sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    offset = sign * (hours * 3600 + minutes * 60)
    return F.when(F.length(zone) <= 1, at).when(F.abs(offset) < 86_400, shift_seconds(at, -offset))


def _syslog_pieces(w: Column, year: Column) -> Column:
    # Seven words, or the line ended early; without ": " there is no message.
    return F.when(
        (F.size(w) == 7) & has(w[6], ": "),
        F.struct(
            _syslog_time(w, year).alias("ts"),
            F.when(w[0] == "E", w[5]).alias("level"),
            w[4].alias("host"),
            before(w[6], ": ").alias("process"),
            after(w[6], ": ").alias("message"),
        ),
    )


def _syslog_record(s: Column, line: Column, year: Column) -> Column:
    container, process, pid = _process_fields(s["process"])
    return F.when(
        s["ts"].isNotNull(),
        parsed(
            timestamp=s["ts"],
            level=normalize_level(s["level"]),
            hostname=s["host"],
            container=container,
            process_name=process,
            pid=pid,
            message=s["message"],
        ),
    )


def syslog_parser(layouts: str = "BEI", precise: bool = False) -> Parser:
    """Syslog in the layouts BSD (B), extended (E), ISO-8601 (I).

    ``precise`` also takes ``Y-m-d H:M:S`` with a blank and lines that start with
    two timestamps, of which the second is the event's.
    """
    return Parser("syslog", (lambda line, year: _words(line, layouts, precise), _syslog_pieces), _syslog_record)


def parse_syslog_bsd(line: Column, year) -> Column:
    return syslog_parser("B")(line, _year(year))


def parse_syslog_ext(line: Column) -> Column:
    return syslog_parser("E")(line)


def parse_syslog_iso(line: Column, precise: bool = False) -> Column:
    return syslog_parser("I", precise)(line)


# ------------------------------------------- dotted time: table and op logs

_DOTTED = rf"(\d{{4}})-(\d\d)-(\d\d)\.({_CLOCK})\.([^|]*)\|"


def _timed(p: Column, ts: Column) -> Column:
    """Pieces with their time, so that the time is worked out once."""
    return F.struct(p.alias("p"), ts.alias("ts"))


def _dotted_time(p: Column) -> Column:
    fraction = F.when(F.translate(p[5], "0123456789", "") == "", p[5]).otherwise(
        F.regexp_extract(p[5], r"^(\d*)", 1)
    )
    return utc(p[1], p[2], p[3], p[4], fraction)


def _dotted_stages(java: str, layout: list[int | str]) -> tuple[Callable[[Column, Column], Column], ...]:
    return (
        lambda line, year: captures(line, java, layout),
        lambda p, year: F.when(matched(p, layout), _timed(p, _dotted_time(p))),
    )


# Operations of table-change logs.
TABLE_OPS = ("SET", "DEL", "HSET", "HDEL", "GETRESPONSE", "PLANNINGRESPONSE")

# After the time: content, table, :key, |rest, second, |tail, tail, third, what follows it.
_TABLE = rf"(?s)\A{_DOTTED}(([^|:]*)(:[^|]*)?(\|([^|]*)(\|(([^|]*)(?:\|(.*))?))?)?)\z"
_TABLE_LAYOUT = list(range(1, 15))


def _table_record(s: Column, line: Column, year: Column) -> Column:
    p, ts = s["p"], s["ts"]
    content, table, key, rest, second, has_tail, tail, third, follow = [p[i] for i in range(6, 15)]
    piped, keyed, tailed = rest != "", key != "", has_tail != ""
    known = second.isin(*TABLE_OPS)
    with_key = piped & keyed
    op_second = piped & ~keyed & known
    sub_key = piped & ~keyed & ~known & tailed
    component = F.when(with_key | op_second | sub_key, table)
    context = F.when(with_key, F.substring(key, 2, MAX_TEXT)).when(sub_key, second)
    function = F.when(with_key | op_second, second).when(sub_key, third)
    message = F.when(with_key | op_second, tail).when(sub_key, follow).otherwise(content)
    return F.when(
        (F.octet_length(line) >= 22) & ts.isNotNull(),
        parsed(timestamp=ts, component_name=component, context=context, function=function, message=message),
    )


TABLE_PARSER = Parser("table_log", _dotted_stages(_TABLE, _TABLE_LAYOUT), _table_record)


def parse_table_log(line: Column) -> Column:
    return TABLE_PARSER(line)


# Operation codes of op logs and the function each stands for.
OP_FUNCTIONS = {
    "c": "Create",
    "s": "Set",
    "g": "Get",
    "p": "CounterPoll",
    "r": "Remove",
    "G": "GetResponse",
    "C": "BulkCreate",
    "R": "BulkRemove",
    "S": "BulkSet",
    "B": "BulkGet",
    "q": "Query: ",
    "Q": "QueryResponse: ",
    "n": "Notification: ",
    "a": "NotifySyncd",
    "A": "NotifySyncdResponse",
}

# After the code: detail, first, its type, :context, |rest, rest, second, its type, :context, what follows it.
_OP = rf"(?s)\A{_DOTTED}([\x00-\x7f])(?:\|((([^|:]*)(:[^|]*)?)(\|((([^|:]*)(:[^|]*)?)(?:\|(.*))?))?))?\z"
_OP_LAYOUT: list[int | str] = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16]


def _type_context(whole_text: Column, kind: Column, context: Column) -> tuple[Column, Column]:
    """``type:context`` split at the first colon (a colon in front does not split)."""
    split = (kind != "") & (context != "")
    component = F.when(whole_text != "", F.when(split, kind).otherwise(whole_text))
    return component, F.when(split, F.nullif(F.substring(context, 2, MAX_TEXT), F.lit("")))


def _op_record(s: Column, line: Column, year: Column) -> Column:
    p, ts = s["p"], s["ts"]
    op, detail, first, kind1, context1, piped, rest, second, kind2, context2, follow = [p[i] for i in range(6, 17)]
    single, bulk, named = op.isin("c", "s", "g", "p"), op.isin("C", "R", "S", "B"), op.isin("q", "Q", "n")
    single_kind, single_context = _type_context(first, kind1, context1)
    query_kind, query_context = _type_context(second, kind2, context2)
    # Remove has nothing after type and context, so its whole detail counts.
    colon = F.when(has(detail, ":"), F.substr(detail, F.instr(detail, ":"))).otherwise(F.lit(""))
    remove_kind, remove_context = _type_context(detail, before(detail, ":"), colon)
    entries = F.instr(detail, "||")
    # A second segment that is followed by more counts as context even without a colon.
    more = F.length(rest) > F.length(second)
    component = (
        F.when(single, single_kind)
        .when(op == "r", remove_kind)
        .when(bulk & (entries > 0), F.substr(detail, F.lit(1), entries - 1))
        .when((op == "q") & (piped != ""), query_kind)
    )
    context = (
        F.when(single, single_context)
        .when(op == "r", remove_context)
        .when((op == "q") & (piped != ""), F.when(more, F.coalesce(query_context, second)).otherwise(query_context))
        .when(op == "a", detail)
    )
    trimmed = F.when(F.endswith(rest, F.lit("|")), F.left(rest, F.length(rest) - 1)).otherwise(rest)
    message = (
        F.when(single | (op == "Q"), rest)
        .when(op == "r", F.lit(""))
        .when(bulk & (entries > 0), F.substr(detail, entries))
        .when(op == "q", follow)
        .when(op == "n", trimmed)
        .otherwise(detail)
    )
    function = op
    for code, text in OP_FUNCTIONS.items():
        function = F.when(op == code, F.lit(text)).otherwise(function)
    function = F.when(named, F.concat(function, first)).otherwise(function)
    return F.when(
        (F.octet_length(line) >= 24) & ts.isNotNull(),
        parsed(
            timestamp=ts,
            level=F.when(op == "n", "NOTICE").otherwise("INFO"),
            component_name=component,
            context=context,
            function=function,
            message=message,
        ),
    )


OP_PARSER = Parser("op_log", _dotted_stages(_OP, _OP_LAYOUT), _op_record)


def parse_op_log(line: Column) -> Column:
    """One line of an op log; responses get their context from ``carry_request_context``."""
    return OP_PARSER(line)


# ---------------------------------------------------------------- custom regex

# Capture groups that fill a log field; all others are metadata.
KNOWN_GROUPS = {
    "timestamp": "timestamp",
    "level": "level",
    "message": "message",
    "pid": "pid",
    "tid": "tid",
    "component": "component_name",
    "process": "process_name",
    "hostname": "hostname",
    "container": "container",
}


def regex_parser(name: str, pattern: str, ts_format: str | None = None) -> Parser:
    """Parser of a regex with named groups (``(?P<name>…)``).

    A group that took part with empty text counts as present when it cannot be
    skipped by the pattern; an empty optional group counts as absent.
    """
    p = translate(pattern)
    layout = list(p.numbers)
    java = whole(p.java)

    def build(caps: Column, line: Column, year: Column) -> Column:
        fields, extra = {}, []
        for i, group in enumerate(p.names, start=1):
            text = F.nullif(caps[i], F.lit("")) if group in p.optional else caps[i]
            target = KNOWN_GROUPS.get(group)
            if target is None:
                extra.append(F.when(text.isNotNull(), F.struct(F.lit(group).alias("k"), text.alias("v"))))
            elif target == "timestamp":
                fields[target] = parse_ts(text, ts_format, year)
            elif target == "level":
                fields[target] = normalize_level(text)
            elif target in ("pid", "tid"):
                fields[target] = u32(text)
            else:
                fields[target] = text
        fields["message"] = F.coalesce(fields.get("message", F.lit("")), F.lit(""))
        if extra:
            found = F.array_compact(F.array(*extra))
            fields["metadata"] = F.when(F.size(found) > 0, F.map_from_entries(found))
        hit = matched(caps, layout) if layout else F.coalesce(line.rlike(p.java), F.lit(False))
        return F.when(hit, parsed(**fields))

    prepare = (lambda line, y: captures(line, java, layout)) if layout else (lambda line, y: F.array(line))
    return Parser(name, (prepare,), build)


def parse_regex(line: Column, pattern: str, ts_format: str | None = None, year=None) -> Column:
    return regex_parser("regex", pattern, ts_format)(line, _year(year))


# The three generic layouts, tried in this order.
GENERIC_PATTERNS = (
    (
        "iso_level",
        r"^(?P<timestamp>\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+"
        r"(?P<level>TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\s+(?P<message>.*)",
    ),
    (
        "iso_bracket_level",
        r"^(?P<timestamp>\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+\[(?P<level>\w+)\]\s+(?P<message>.*)",
    ),
    (
        "level_iso",
        r"^(?P<level>TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\s+"
        r"(?P<timestamp>\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(?P<message>.*)",
    ),
)
LEVEL_WORDS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL")


def generic_parsers() -> list[Parser]:
    return [regex_parser(name, pattern) for name, pattern in GENERIC_PATTERNS]


def parse_generic(line: Column) -> Column:
    return F.coalesce(*[p(line) for p in generic_parsers()])


def _fallback_record(p: Column, line: Column, year: Column) -> Column:
    # Everything up to a line break, as ``.`` takes it; a line of breaks only is refused.
    return F.when(F.length(p) > 0, parsed(message=p))


FALLBACK_PARSER = Parser(
    "fallback",
    (lambda line, year: F.when(has(line, "\n"), F.regexp_extract(line, "([^\\n]+)", 1)).otherwise(line),),
    _fallback_record,
)


def parse_fallback(line: Column, ingest_ts=None) -> Column:
    """The whole line as message at the job's ingest time; NULL for an empty line."""
    got = FALLBACK_PARSER(line)
    if ingest_ts is None:
        return got
    return F.when(got.isNotNull(), got.withField("timestamp", F.lit(ingest_ts).cast("timestamp")))
