"""Projections: export fields, unpivot, expanded leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import level_title
from ..functions.timestamps import fmt_ts, rfc3339

DEFAULT_FIELDS = ("timestamp", "level", "hostname", "component", "pid", "message")

# Names under which a field can be exported.
EXPORT_NAMES = {
    "timestamp": "timestamp",
    "time": "timestamp",
    "ts": "timestamp",
    "level": "level",
    "severity": "level",
    "message": "message",
    "msg": "message",
    "hostname": "hostname",
    "host": "hostname",
    "component": "component_name",
    "service": "component_name",
    "logger": "component_name",
    "process": "process_name",
    "process_name": "process_name",
    "pid": "pid",
    "tid": "tid",
    "thread": "tid",
    "container": "container",
    "context": "context",
    "function": "function",
    "source": "source",
    "raw": "raw",
}


def export_field(name: str) -> Column:
    """Text of an export field: '' when missing; unknown names come from the metadata."""
    target = EXPORT_NAMES.get(name.lower())
    if target is None:
        text = F.try_element_at(F.col("metadata"), F.lit(name))
    elif target == "timestamp":
        text = rfc3339(F.col(target))
    elif target == "level":
        text = level_title(F.col(target))
    else:
        text = F.col(target).cast("string")
    return F.coalesce(text, F.lit(""))


def chosen_fields(fields: Sequence[str] | None) -> list[str]:
    fields = list(fields or ())
    return list(DEFAULT_FIELDS) if not fields or fields == ["all"] else fields


def select_fields(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    return df.select(*[export_field(f).alias(f) for f in chosen_fields(fields)])


def explode_attrs(df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per expanded leaf: ``pos, path, label, value, depth``."""
    steps = F.regexp_count(F.col("leaf.path"), F.lit(r"\.|\["))
    return df.select(*keep, F.posexplode("expanded").alias("pos", "leaf")).select(
        *keep, "pos", "leaf.path", "leaf.label", "leaf.value", steps.alias("depth")
    )


def unpivot_fields(df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """One row per present field: ``pos, field, value``; metadata entries as ``Meta: k = v``."""
    shown = [
        ("Timestamp", fmt_ts(F.col("timestamp"), "millis")),
        ("Level", F.coalesce("level", F.lit("-"))),
        ("Source", F.col("source")),
        ("Hostname", F.col("hostname")),
        ("Container", F.col("container")),
        ("Context", F.col("context")),
        ("Function", F.col("function")),
        ("Component", F.col("component_name")),
        ("Process", F.col("process_name")),
        ("PID", F.col("pid").cast("string")),
        ("TID", F.col("tid").cast("string")),
    ]
    pair = lambda label, value: F.struct(F.lit(label).alias("field"), value.alias("value"))
    fixed = F.array_compact(F.array(*[F.when(v.isNotNull(), pair(n, v)) for n, v in shown]))
    meta = F.transform(
        F.array_sort(F.map_entries("metadata")),
        lambda e: pair("Meta", F.concat(e["key"], F.lit(" = "), F.coalesce(e["value"], F.lit("")))),
    )
    rows = F.concat(fixed, F.coalesce(meta, F.array().cast("array<struct<field:string,value:string>>")))
    return df.select(*keep, F.posexplode(rows).alias("pos", "p")).select(*keep, "pos", "p.field", "p.value")
