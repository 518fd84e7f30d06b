"""Use an existing table as ``logs``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import level_rank
from ..schema import LOG_SCHEMA


def as_logs(df: DataFrame, mapping: dict[str, Column | str], keep: Sequence[str] = ()) -> DataFrame:
    """``logs`` rows of any table: mapped columns, ``level_rank`` derived, the rest NULL; ``keep`` as they are."""
    unknown = set(mapping) - {f.name for f in LOG_SCHEMA.fields}
    if unknown:
        raise ValueError(f"not log columns: {sorted(unknown)}")
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    given = {k: as_col(v) for k, v in mapping.items()}
    given.setdefault("message", F.lit(""))
    given.setdefault("raw", given["message"])
    given.setdefault("source", F.lit("table"))
    given.setdefault("loader_id", given["source"])
    if "level" in given:
        given.setdefault("level_rank", level_rank(given["level"]))
    return df.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields],
        *keep,
    )
