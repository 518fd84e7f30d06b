"""JSON log lines: well-known keys to fields, the rest to metadata and a payload tree."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.levels import normalize_level
from ..functions.text import json_of, number_text
from ..functions.timestamps import parse_json_ts
from ..schema import PARSED_TYPE
from .parsers import Parser, let, parsed, u32

# Keys (lower case) that fill a log field.
KEY_FIELDS = {
    "timestamp": "time",
    "time": "time",
    "ts": "time",
    "@timestamp": "time",
    "level": "level",
    "severity": "level",
    "loglevel": "level",
    "message": "message",
    "msg": "message",
    "log": "message",
    "hostname": "host",
    "host": "host",
    "service": "component",
    "component": "component",
    "logger": "component",
    "name": "component",
    "pid": "pid",
    "tid": "tid",
    "thread": "tid",
}

# Containers nested deeper than this are shown as "...".
MAX_DEPTH = 10

_BLANKS = " \t\r\n"


def json_object(line: Column) -> Column:
    """The line as ``MAP<STRING, VARIANT>`` in key order; NULL unless it is exactly one JSON object."""
    text = F.trim(line, F.lit(_BLANKS))
    # Inside brackets, anything after the object is an error or a second element.
    wrapped = F.when(F.startswith(text, F.lit("{")), F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    one = F.try_variant_get(wrapped, "$", "array<variant>")
    return F.when(F.size(one) == 1, F.try_variant_get(wrapped, "$[0]", "map<string,variant>"))


def _text(json: Column, value: Column, depth: int = 0) -> Column:
    """Text of a value whose JSON form is known: strings bare, null as ``null``, numbers as they were meant.

    The numbers inside containers are told apart down to ``depth`` levels.
    """
    text = F.when(json.startswith('"'), F.try_variant_get(value, "$", "string"))
    if depth:
        return text.when(json.rlike(r"[\d\[{]"), json_of(value, depth)).otherwise(json)
    return text.when(F.substring(json, 1, 1).isin(*"-0123456789"), number_text(value)).otherwise(json)


def _entries(line: Column, depth: int = 2) -> Column:
    """Members of the object: ``key, field`` (that it fills, if any), ``json, text, value, ts, mapped``.

    The first character of ``json`` tells the kind of value.
    """
    fields = F.create_map(*[F.lit(x) for pair in KEY_FIELDS.items() for x in pair])
    pairs = F.transform(
        F.map_entries(json_object(line)),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.try_element_at(fields, F.lower(e["key"])).alias("field"),
            F.to_json(e["value"]).alias("json"),
            e["value"].alias("value"),
        ),
    )
    return F.transform(
        pairs,
        lambda e: let(
            _text(e["json"], e["value"], depth),
            lambda text: let(
                F.when(e["field"] == "time", parse_json_ts(text, _is_text(e), _is_number(e))),
                lambda ts: F.struct(
                    e["key"].alias("key"),
                    e["field"].alias("field"),
                    e["json"].alias("json"),
                    text.alias("text"),
                    e["value"].alias("value"),
                    ts.alias("ts"),
                    # A time must parse and a level must be text to count as taken.
                    F.when(e["field"] == "time", ts.isNotNull())
                    .when(e["field"] == "level", _is_text(e))
                    .otherwise(e["field"].isNotNull())
                    .alias("mapped"),
                ),
            ),
        ),
    )


def _is_container(n: Column) -> Column:
    return n["json"].startswith("{") | n["json"].startswith("[")


def _is_text(e: Column) -> Column:
    return e["json"].startswith('"')


def _is_number(e: Column) -> Column:
    return F.substring(e["json"], 1, 1).isin(*"-0123456789")


def _node(path: Column, label: Column, value: Column) -> Column:
    return F.struct(path.alias("path"), label.alias("label"), F.to_json(value).alias("json"), value.alias("value"))


def _children(n: Column) -> Column:
    members = F.transform(
        F.map_entries(F.try_variant_get(n["value"], "$", "map<string,variant>")),
        lambda e: _node(F.concat(n["path"], F.lit("."), e["key"]), e["key"], e["value"]),
    )
    items = F.transform(
        F.try_variant_get(n["value"], "$", "array<variant>"),
        lambda v, i: let(
            F.concat(F.lit("["), i.cast("string"), F.lit("]")), lambda tag: _node(F.concat(n["path"], tag), tag, v)
        ),
    )
    return (
        F.when(n["json"].startswith("{"), members).when(n["json"].startswith("["), items).otherwise(F.array(n))
    )


def _unfold(nodes: Column, depth: int) -> Column:
    """Leaves of a list of nodes at ``depth``; stops as soon as no container is left."""
    if depth > MAX_DEPTH:
        return nodes
    if depth == MAX_DEPTH:
        # Whatever sits below the last level is cut: it loses its value.
        cut = lambda n: F.transform(_children(n), lambda c: c.withField("json", F.lit(None).cast("string")))
        deeper = F.flatten(F.transform(nodes, lambda n: F.when(_is_container(n), cut(n)).otherwise(F.array(n))))
    else:
        deeper = let(F.flatten(F.transform(nodes, _children)), lambda ns: _unfold(ns, depth + 1))
    return F.when(F.exists(nodes, lambda n: F.coalesce(_is_container(n), F.lit(False))), deeper).otherwise(nodes)


def _shown(n: Column) -> Column:
    text = F.when(n["json"].isNull(), F.lit("...")).otherwise(_text(n["json"], n["value"]))
    return F.struct(n["path"].alias("path"), n["label"].alias("label"), text.alias("value"))


def _payload(entries: Column) -> Column:
    top = F.transform(
        F.filter(entries, lambda e: ~e["mapped"]),
        lambda e: F.struct(
            F.concat(F.lit("Payload."), e["key"]).alias("path"),
            e["key"].alias("label"),
            e["json"].alias("json"),
            e["value"].alias("value"),
        ),
    )
    leaves = let(top, lambda ns: F.when(F.size(ns) > 0, F.transform(_unfold(ns, 0), _shown)))
    return leaves.cast(PARSED_TYPE["expanded"].dataType)


def expand_json(line: Column) -> Column:
    """Leaves of the payload (keys that did not go to a field), in key order."""
    return let(_entries(line, 0), _payload)


def _record(entries: Column, line: Column, year: Column) -> Column:
    def last(field: str) -> Column:
        # Keys come in order; of several that fill a field the last counts.
        return F.try_element_at(F.filter(entries, lambda e: (e["field"] == field) & wanted(field, e)), F.lit(-1))

    def wanted(field: str, e: Column) -> Column:
        return e["mapped"] if field in ("time", "level") else F.lit(True)

    def number(field: str) -> Column:
        return u32(last(field)["text"])

    rest = F.filter(entries, lambda e: e["field"].isNull())
    metadata = F.map_from_entries(F.transform(rest, lambda e: F.struct(e["key"], e["text"])))
    return F.when(
        entries.isNotNull(),
        parsed(
            timestamp=last("time")["ts"],
            level=normalize_level(last("level")["text"]),
            message=F.coalesce(last("message")["text"], F.lit("")),
            hostname=last("host")["text"],
            component_name=last("component")["text"],
            pid=number("pid"),
            tid=number("tid"),
            metadata=F.when(F.size(rest) > 0, metadata),
            expanded=_payload(entries),
        ),
    )


JSON_PARSER = Parser("json", (lambda line, year: _entries(line),), _record)


def parse_json_log(line: Column) -> Column:
    return JSON_PARSER(line)
