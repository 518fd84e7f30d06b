"""Filters: sets, stacks, levels, times, records like this one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import rank_of
from ..schema import LEVELS
from .predicates import all_of, any_of, log_cmp, predicate, usable_predicates

PRESETS = {"ALL": None, **{f"{name}+": rank for rank, name in enumerate(LEVELS[:-1])}, "FATAL": 6}


def set_condition(include: list = (), exclude: list = ()) -> Column:
    """Excludes win; then any include must hold (no includes: keep)."""
    parts = []
    if exclude:
        parts.append(~any_of([predicate(p) for p in exclude]))
    if include:
        parts.append(any_of([predicate(p) for p in include]))
    return all_of(parts)


def filter_set(df: DataFrame, include: list = (), exclude: list = ()) -> DataFrame:
    return df.filter(set_condition(include, exclude))


def stack_condition(entries: list[tuple[object, bool]]) -> Column:
    """Every include must hold and every exclude must not."""
    return all_of([~predicate(p) if exclude else predicate(p) for p, exclude in entries])


def filter_stack(df: DataFrame, entries: list[tuple[object, bool]]) -> DataFrame:
    return df.filter(stack_condition(entries))


def _rank_at_least(rank: int) -> Column:
    # A test on the stored name, not on a computed rank, so that it reaches the scan.
    return F.col("level").isin(*LEVELS[rank:])


def min_level(df: DataFrame, level: str, keep_null: bool = True) -> DataFrame:
    """Severity at least ``level``; records without a level pass unless told otherwise."""
    keep = _rank_at_least(rank_of(level))
    return df.filter(keep | F.col("level").isNull()) if keep_null else df.filter(keep)


def preset_condition(preset: str) -> Column:
    rank = PRESETS[preset]
    return F.lit(True) if rank is None else F.coalesce(_rank_at_least(rank), F.lit(False))


def level_preset(df: DataFrame, preset: str) -> DataFrame:
    """``ALL``, ``TRACE+`` … ``ERROR+``, ``FATAL``; a missing level passes only ``ALL``."""
    return df if PRESETS[preset] is None else df.filter(preset_condition(preset))


def quick_filter(df: DataFrame, text: str, exclude: bool = False) -> DataFrame:
    """Message contains the trimmed text (blank text: no filter)."""
    text = text.strip()
    if not text:
        return df
    hit = log_cmp("message", "contains", text)
    return df.filter(~hit if exclude else hit)


# The fields that a record offers, in this order.
RECORD_FIELDS = (
    "timestamp", "level", "source", "hostname", "container", "context", "function", "process_name", "pid", "tid", "component_name", "message",
)


def like_condition(record: dict, fields: list[str] | None = None, any_field: bool = True) -> Column:
    """``field == this record's value`` over the chosen fields (default: all it has, with metadata)."""
    meta = record.get("metadata") or {}
    if fields is None:
        fields = [f for f in RECORD_FIELDS if record.get(f) is not None] + sorted(meta)
    tests = []
    for name in fields:
        plain = {"component": "component_name", "process": "process_name"}.get(name, name)
        value = record.get(plain) if plain in RECORD_FIELDS else meta.get(name.removeprefix("metadata."))
        if value is None:
            continue
        if plain == "timestamp":
            tests.append(F.coalesce(F.col("timestamp") == F.lit(value).cast("timestamp"), F.lit(False)))
        else:
            tests.append(log_cmp(plain, "==", value))
    if not tests:
        raise ValueError("the record has none of these fields")
    return any_of(tests) if any_field else all_of(tests)


def filter_like(
    df: DataFrame, record: dict, fields: list[str] | None = None, any_field: bool = True, exclude: bool = False
) -> DataFrame:
    cond = like_condition(record, fields, any_field)
    return df.filter(~cond if exclude else cond)


def time_range(df: DataFrame, after=None, before=None, exclude: bool = False) -> DataFrame:
    """Records from ``after`` to ``before``; the boundary records always stay.

    With ``exclude``, records strictly beyond ``after`` and those strictly short
    of ``before`` go.
    """
    ts = F.col("timestamp")
    parts = []
    if before is not None:
        moment = F.lit(before).cast("timestamp")
        parts.append(ts >= moment if exclude else ts <= moment)
    if after is not None:
        moment = F.lit(after).cast("timestamp")
        parts.append(ts <= moment if exclude else ts >= moment)
    return df.filter(all_of(parts)) if parts else df


def apply_filter_set(df: DataFrame, spec: dict) -> DataFrame:
    """Named filter set ``{filters: [{expr, exclude}], level_filter}``; unusable entries warn and are skipped."""
    entries = spec.get("filters") or []
    parts = []
    preset = spec.get("level_filter")
    if preset in PRESETS and PRESETS[preset] is not None:
        parts.append(preset_condition(preset))
    for i, cond in usable_predicates(df.sparkSession, [e["expr"] for e in entries], "filter"):
        parts.append(~cond if entries[i].get("exclude", False) else cond)
    return df.filter(all_of(parts)) if parts else df


def filter_attr(df: DataFrame, path: str, value: str) -> DataFrame:
    """Records with an expanded leaf ``path == value``."""
    hit = F.exists("expanded", lambda leaf: (leaf["path"] == path) & (leaf["value"] == value))
    return df.filter(F.coalesce(hit, F.lit(False)))


def matches(df: DataFrame, cond, name: str = "matches") -> DataFrame:
    """Add the pass/fail flag of a predicate."""
    return df.withColumn(name, predicate(cond))
