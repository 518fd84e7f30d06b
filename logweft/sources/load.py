"""Load many inputs of different formats into one ``logs`` table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.chain import (
    OP_PARSER,
    carry_request_context,
    detect_formats,
    expand_attributes,
    parse_lines,
    to_logs,
)
from ..operators.ordering import assign_ids, ids_in_file_order
from ..schema import LOG_SCHEMA
from .packed import read_gzip_lines, read_zip_lines
from .text import read_lines


def expand_paths(spark: SparkSession, patterns: Sequence[str]) -> list[list[str]]:
    """Files of each glob pattern, sorted; a pattern that matches nothing gives an empty list."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path_class = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = []
    for pattern in patterns:
        p = path_class(pattern)
        found = p.getFileSystem(hadoop).globStatus(p) or []
        out.append(sorted(s.getPath().toUri().toString() for s in found if s.isFile()))
    return out


def _kind(path: str) -> str:
    low = path.lower()
    return "zip" if low.endswith(".zip") else "gzip" if low.endswith(".gzip") else "text"


_READERS = {"text": read_lines, "zip": read_zip_lines, "gzip": read_gzip_lines}

# Per-source tables up to this many rows are sent to every task; larger ones are joined by shuffle.
BROADCAST_SOURCES = 200_000


def _same_form(path: Column) -> Column:
    """Path with one slash after the scheme, however its reader writes it."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def read_all_lines(spark: SparkSession, patterns: Sequence[str]) -> tuple[DataFrame, bool] | None:
    """Lines of all inputs with ``source_ord`` (position of the pattern), read in one scan per kind of file.

    Also tells whether partitions still hold the lines in file order. None when nothing matches.
    """
    per_pattern = expand_paths(spark, patterns)
    owners: dict[str, int] = {}
    for ordinal, files in enumerate(per_pattern):
        for f in files:
            owners.setdefault(f, ordinal)
    if not owners:
        return None
    parts = []
    for kind, reader in _READERS.items():
        chosen = [f for f in owners if _kind(f) == kind]
        if chosen:
            parts.append(reader(spark, chosen))
    lines = reduce(DataFrame.unionByName, parts)
    used = {o for o in owners.values()}
    if len(used) == 1:
        return lines.withColumn("source_ord", F.lit(used.pop())), True
    small = len(owners) <= BROADCAST_SOURCES
    table = spark.createDataFrame(list(owners.items()), "__path string, source_ord int").withColumn(
        "__path", _same_form(F.col("__path"))
    )
    keyed = lines.withColumn("__path", _same_form(F.col("source")))
    return keyed.join(F.broadcast(table) if small else table, "__path", "left").drop("__path"), small


def read_logs(
    spark: SparkSession,
    patterns: str | Sequence[str],
    formats: str | DataFrame | None = None,
    ingest_ts=None,
    ids: bool = True,
    precise: bool = False,
) -> DataFrame:
    """Read, detect, parse and number the records of files, archives and globs.

    ``formats`` skips detection, which costs a pass over the inputs. ``ids=False``
    leaves ``id`` NULL and saves the numbering.
    """
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    found = read_all_lines(spark, patterns)
    if found is None:
        return spark.createDataFrame([], LOG_SCHEMA)
    lines, in_order = found
    if formats is None:
        formats = detect_formats(lines).cache()
    if isinstance(formats, DataFrame):
        kinds = [r["format"] for r in formats.select("format").distinct().limit(2).collect()]
        if len(kinds) == 1:
            formats = kinds[0]
        elif formats.count() <= BROADCAST_SOURCES:
            formats = F.broadcast(formats)
        else:
            in_order = False
    stateful = (
        formats == "op_log" if isinstance(formats, str) else not formats.filter(F.col("format") == "op_log").isEmpty()
    )
    logs = to_logs(parse_lines(lines, formats, precise), ingest_ts)
    if stateful:
        is_op = F.col("parser") == OP_PARSER.name
        carried = carry_request_context(logs.filter(is_op))
        logs = carried.unionByName(logs.filter(~is_op))
        in_order = False
    logs = expand_attributes(logs).drop("parser")
    if not ids:
        return logs
    numbered = ids_in_file_order(logs) if in_order else assign_ids(logs)
    return numbered.drop("source_ord", "block_start", "seq")
