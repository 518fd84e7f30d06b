"""OTLP log-export documents (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_REQUEST = """
STRUCT<resourceLogs: ARRAY<STRUCT<scopeLogs: ARRAY<STRUCT<logRecords: ARRAY<STRUCT<
  timeUnixNano: STRING, severityText: STRING, body: STRUCT<stringValue: STRING>>>>>>>>
"""


def otlp_records(docs: DataFrame, json: str = "value") -> DataFrame:
    """Log records of OTLP documents, one row each, in document order.

    ``line`` is ``time severity body`` with absent parts left out; records
    without any part are dropped, and so are documents that are not JSON.
    """
    keep = [c for c in docs.columns if c != json]
    request = F.from_json(F.when(F.try_parse_json(json).isNotNull(), F.col(json)), _REQUEST)
    records = (
        docs.select(*keep, request.alias("r"))
        .select(*keep, F.posexplode("r.resourceLogs").alias("resource_no", "r"))
        .select(*keep, "resource_no", F.posexplode("r.scopeLogs").alias("scope_no", "r"))
        .select(*keep, "resource_no", "scope_no", F.posexplode("r.logRecords").alias("record_no", "r"))
    )
    nanos = F.col("r.timeUnixNano")
    parts = [nanos, F.col("r.severityText"), F.col("r.body.stringValue")]
    present = parts[0].isNotNull() | parts[1].isNotNull() | parts[2].isNotNull()
    micros = F.floor(nanos.try_cast("decimal(20,0)") / 1000).cast("bigint")
    return records.filter(present).select(
        *keep,
        "resource_no",
        "scope_no",
        "record_no",
        F.concat_ws(" ", *parts).alias("line"),
        F.timestamp_micros(micros).alias("timestamp"),
        F.col("r.severityText").alias("severity"),
        F.col("r.body.stringValue").alias("body"),
    )


def read_otlp_json(spark: SparkSession, path, whole_file: bool = True) -> DataFrame:
    """Records of OTLP files: one document per file, or one per line."""
    docs = spark.read.text(path, wholetext=whole_file)
    return otlp_records(docs.select(F.col("_metadata.file_path").alias("source"), "value"))
