"""From lines to logs: format detection, fallback chain, failures, carry-forward, expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from ..functions.levels import level_rank
from ..functions.timestamps import MONTH_RE
from ..plans.scan import CHUNK_BITS, Scan, scan
from ..schema import LEAF_TYPE, LOG_COLUMNS, PARSED_TYPE
from ..sources.text import sample_lines
from .json_log import JSON_PARSER
from .parsers import (
    FALLBACK_PARSER,
    LEVEL_WORDS,
    OP_FUNCTIONS,
    OP_PARSER,
    TABLE_PARSER,
    Parser,
    after,
    before,
    generic_parsers,
    has,
    syslog_parser,
)

FORMATS = ("op_log", "table_log", "syslog", "json", "generic")
DETECT_LINES = 5

_OP_LIKE = rf"(?s)\A[^\n]{{4}}-..-..\..{{9}}[^|]*\|[{''.join(OP_FUNCTIONS)}]\|"
_TABLE_LIKE = r"\A\d{4}-\d{2}-\d{2}\.\d{2}:\d{2}:\d{2}\.\d+\|"
_BSD_LIKE = rf"(?s)\A(?:{MONTH_RE}).{{13}}"
_EXT_LIKE = rf"(?s)\A\d{{4}} (?:{MONTH_RE}).{{12}}"
_ISO_LIKE = r"(?s)\A\d{4}-\d\d-\d\dT.{9}"
_ISO_LEVEL = rf"(?s)\A.{{10}}\S*\s+(?:{'|'.join(LEVEL_WORDS)})(?:\s|\z)"


def looks_like(line: Column) -> dict[str, Column]:
    """Cheap test of a sample line for each detectable format."""
    trimmed = F.trim(line, F.lit(" \t\r\n"))
    iso = line.rlike(_ISO_LIKE) & ~line.rlike(_ISO_LEVEL)
    return {
        "op_log": (F.octet_length(line) >= 24) & line.rlike(_OP_LIKE),
        "table_log": line.rlike(_TABLE_LIKE),
        "syslog": line.rlike(_BSD_LIKE) | line.rlike(_EXT_LIKE) | iso,
        "json": trimmed.startswith("{") & trimmed.endswith("}"),
    }


def detect_formats(lines: DataFrame) -> DataFrame:
    """``source, format``: the first format that most of a source's first non-blank lines look like."""
    sample = sample_lines(lines, DETECT_LINES)
    filled = F.trim(F.col("line"), F.lit(" \t\r\n")) != ""
    tests = looks_like(F.col("line"))
    votes = sample.groupBy("source").agg(
        F.count_if(filled).alias("_n"), *[F.count_if(filled & t).alias(name) for name, t in tests.items()]
    )
    fmt = reduce(
        lambda rest, name: F.when(F.col(name) * 2 > F.col("_n"), F.lit(name)).otherwise(rest),
        reversed(list(tests)),
        F.lit("generic"),
    )
    return votes.select("source", fmt.alias("format"))


def format_parsers(fmt: str, precise: bool = False) -> list[Parser]:
    """The chain for a detected format: its own parser, the generic layouts, the catch-all."""
    own = {
        "op_log": [OP_PARSER],
        "table_log": [TABLE_PARSER],
        "syslog": [syslog_parser(precise=precise)],
        "json": [JSON_PARSER],
        "generic": [],
    }[fmt]
    return own + generic_parsers() + [FALLBACK_PARSER]


def parse_chain(
    lines: DataFrame, parsers: list[Parser | tuple[Parser, Column]], line: str = "line", year: str | None = "mod_year"
) -> DataFrame:
    """Add ``parsed`` (struct or NULL) and ``parser`` (who made it): the first that accepts wins.

    A parser may come with a condition on the row (its source's format). Later
    parsers are not evaluated for rows that are already taken, and each step
    is a projection of its own, so nothing is computed twice.
    """
    text = F.col(line)
    year_col = F.col(year) if year and year in lines.columns else F.lit(None).cast("int")
    out, got = lines, []
    for n, entry in enumerate(parsers):
        parser, cond = entry if isinstance(entry, tuple) else (entry, None)
        tests = [F.col(f"__got{i}").isNull() for i in range(n)] + ([] if cond is None else [cond])
        todo = reduce(Column.__and__, tests) if tests else None
        last = text
        for i, stage in enumerate(parser.stages):
            out = out.withColumn(f"__s{i}", stage(last, year_col) if todo is None else F.when(todo, stage(last, year_col)))
            last = F.col(f"__s{i}")
        made = parser.build(last, text, year_col)
        out = out.withColumn(f"__got{n}", made if todo is None else F.when(todo, made))
        out = out.drop(*[f"__s{i}" for i in range(len(parser.stages))])
        got.append((F.col(f"__got{n}"), parser.name))
    result = F.coalesce(*[g for g, _ in got])
    name = F.coalesce(*[F.when(g.isNotNull(), F.lit(n)) for g, n in got])
    return out.select(*lines.columns, _parsed_once(result).alias("parsed"), _parsed_once(name).alias("parser"))


def _parsed_once(c: Column) -> Column:
    """The value unchanged, in a form that filters are not moved below.

    Spark would otherwise copy the whole parse into a filter next to the scan
    and parse every line again for the rows that pass.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def parse_lines(
    lines: DataFrame, formats: DataFrame | str | None = None, precise: bool = False
) -> DataFrame:
    """Parse lines by the format of their source.

    ``formats``: one format for everything, or the table of ``detect_formats``
    (default: detect now; one row per source).
    """
    if isinstance(formats, str):
        return parse_chain(lines, format_parsers(formats, precise))
    if formats is None:
        formats = detect_formats(lines)
    typed = lines.join(formats, "source", "left")
    fmt = F.col("format")
    chain: list[Parser | tuple[Parser, Column]] = [
        (OP_PARSER, fmt == "op_log"),
        (TABLE_PARSER, fmt == "table_log"),
        (syslog_parser(precise=precise), fmt == "syslog"),
        (JSON_PARSER, fmt == "json"),
        *generic_parsers(),
        FALLBACK_PARSER,
    ]
    return parse_chain(typed, chain).drop("format")


def failed_lines(parsed: DataFrame) -> DataFrame:
    """Lines that no parser took."""
    return parsed.filter(F.col("parsed").isNull()).select(F.col("line").alias("raw"), "source", "loader_id")


ORDER_COLUMNS = ("source_ord", "block_start", "seq")


def to_logs(parsed: DataFrame, ingest_ts=None) -> DataFrame:
    """``logs`` rows of the parsed lines, keeping the arrival-order columns; ``id`` is still NULL.

    Records without a time get the job's ingest time.
    """
    ingest = (F.current_timestamp() if ingest_ts is None else F.lit(ingest_ts)).cast("timestamp")
    kept = [c for c in ORDER_COLUMNS if c in parsed.columns]
    made = {f.name: F.col(f"parsed.{f.name}") for f in PARSED_TYPE.fields}
    made["timestamp"] = F.coalesce(made["timestamp"], ingest)
    made["id"] = F.lit(None).cast("bigint")
    made["level_rank"] = level_rank(F.col("parsed.level"))
    made["source"], made["loader_id"], made["raw"] = F.col("source"), F.col("loader_id"), F.col("line")
    return parsed.filter(F.col("parsed").isNotNull()).select(
        *[made[c].alias(c) for c in LOG_COLUMNS], *kept, "parser"
    )


# ------------------------------------------------------- requests and responses


def carry_request_context(df: DataFrame, by: str = "source", order: tuple[str, ...] = ("block_start", "seq")) -> DataFrame:
    """Give responses the context (and component) of the latest request of their kind.

    ``df`` has ``function``, ``context`` and ``component_name`` of op-log rows.
    The latest request counts even if it has no context. A source is scanned in
    chunks, so one huge file is not one task.
    """
    fn = F.col("function")
    request = F.struct("context", "component_name")
    kinds = {
        "__get": (fn == OP_FUNCTIONS["g"], fn == OP_FUNCTIONS["G"]),
        "__query": (fn.startswith(OP_FUNCTIONS["q"]), fn.startswith(OP_FUNCTIONS["Q"])),
        "__notify": (fn == OP_FUNCTIONS["a"], fn == OP_FUNCTIONS["A"]),
    }
    chunked = df.withColumn("__chunk", F.shiftright(order[-1], CHUNK_BITS))
    out = scan(
        chunked,
        [Scan(name, F.when(asks, request), "last") for name, (asks, _) in kinds.items()],
        by=[by],
        chunks=[*order[:-1], "__chunk"],
        order=list(order),
    )
    context, component = F.col("context"), F.col("component_name")
    for name, (_, answers) in kinds.items():
        context = F.when(answers, F.col(f"{name}.context")).otherwise(context)
        if name != "__notify":
            component = F.when(answers, F.col(f"{name}.component_name")).otherwise(component)
    return out.withColumns({"context": context, "component_name": component}).drop(*kinds, "__chunk")


# ------------------------------------------------------------------- expansion


def _leaf(label: str, value: Column) -> Column:
    return F.when(
        value.isNotNull(), F.struct(F.lit(label).alias("path"), F.lit(label).alias("label"), value.alias("value"))
    )


def _attributes(text: Column, sep: str, need_sep: bool) -> Column:
    parts = F.filter(F.split(text, r"\|"), lambda a: has(a, sep) if need_sep else a != "")
    return F.transform(
        parts,
        lambda a: F.struct(
            F.concat(F.lit("Attributes."), before(a, sep)).alias("path"),
            before(a, sep).alias("label"),
            after(a, sep).alias("value"),
        ),
    )


def expand_table(function: Column, component: Column, context: Column, message: Column) -> Column:
    """Leaves of a table-change record (NULL without an operation)."""
    fixed = F.array_compact(F.array(_leaf("Operation", function), _leaf("Table", component), _leaf("Key", context)))
    return F.when(function.isNotNull(), F.concat(fixed, _attributes(message, ":", True)))


def expand_op(function: Column, component: Column, context: Column, message: Column) -> Column:
    """Leaves of an op record; responses show their status first."""
    replies_with_request = (function == OP_FUNCTIONS["G"]) | function.startswith(OP_FUNCTIONS["Q"])
    response = replies_with_request | (function == OP_FUNCTIONS["A"])
    first = before(message, "|")
    status = F.when(response, F.nullif(F.when(has(first, "="), after(first, "=")).otherwise(first), F.lit("")))
    attributes = F.when(response, after(message, "|")).otherwise(message)
    head = F.array_compact(
        F.array(
            _leaf("Operation", function), _leaf("Object Type", component), _leaf("OID", context), _leaf("Status", status)
        )
    )
    tail = F.array_compact(F.array(_leaf("Request Context", F.when(replies_with_request, context))))
    return F.when(function.isNotNull(), F.concat(head, _attributes(attributes, "=", False), tail))


def expand_attributes(df: DataFrame) -> DataFrame:
    """Fill ``expanded`` of table- and op-log rows (``parser`` tells which is which)."""
    cols = [F.col(c) for c in ("function", "component_name", "context", "message")]
    made = (
        F.when(F.col("parser") == TABLE_PARSER.name, expand_table(*cols))
        .when(F.col("parser") == OP_PARSER.name, expand_op(*cols))
        .otherwise(F.col("expanded") if "expanded" in df.columns else F.lit(None))
    )
    return df.withColumn("expanded", made.cast(ArrayType(LEAF_TYPE)))
