"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Severity order; the position is the level's rank.
LEVELS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "ERROR", "FATAL")

LEAF_TYPE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

LINE_SCHEMA = T.StructType(
    [
        T.StructField("loader_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("line", T.StringType()),
        T.StructField("mod_year", T.IntegerType()),
    ]
)

# What a parser makes out of one line.
PARSED_TYPE = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("tid", T.LongType()),
        T.StructField("component_name", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("function", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("expanded", T.ArrayType(LEAF_TYPE)),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("level_rank", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("tid", T.LongType()),
        T.StructField("component_name", T.StringType()),
        T.StructField("process_name", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("function", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("loader_id", T.StringType()),
        T.StructField("expanded", T.ArrayType(LEAF_TYPE)),
    ]
)

LOG_COLUMNS = tuple(f.name for f in LOG_SCHEMA.fields)
