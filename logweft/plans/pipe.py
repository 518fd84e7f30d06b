"""The end-to-end pipe: read, parse, filter, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import min_level, set_condition
from ..operators.predicates import usable_predicates
from ..operators.sinks import write_csv, write_json, write_raw, write_yaml
from ..sources.load import read_logs

_WRITERS = {"json": write_json, "yaml": write_yaml, "csv": write_csv}


def pipe_filter(logs: DataFrame, filters: Sequence = (), level: str | None = None) -> DataFrame:
    """Minimum level (records without one pass), then any of the filters; unusable filters warn and are ignored."""
    out = min_level(logs, level) if level else logs
    usable = usable_predicates(logs.sparkSession, list(filters), "filter")
    return out.filter(set_condition(include=[c for _, c in usable])) if usable else out


def pipe(
    spark: SparkSession,
    paths: str | Sequence[str],
    filters: Sequence = (),
    level: str | None = None,
    fmt: str = "raw",
    fields: Sequence[str] | None = None,
    out: str | None = None,
    ids: bool = False,
    **read_options,
) -> DataFrame:
    """Read logs, keep what passes and, with ``out``, write it as raw, json, yaml or csv.

    Nothing is sorted or shuffled: one pass from the files to the output. Give
    ``ids=True`` when a filter uses ``id``.
    """
    kept = pipe_filter(read_logs(spark, paths, ids=ids, **read_options), filters, level)
    if out is not None:
        if fmt == "raw":
            write_raw(kept, out)
        else:
            _WRITERS[fmt](kept, out, fields)
    return kept
