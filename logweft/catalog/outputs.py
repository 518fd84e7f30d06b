"""Sinks: logs are written in each format and the files are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sinks as si
from ..operators.aggregates import count_by_level
from ..operators.chain import parse_chain, to_logs
from ..operators.filters import filter_set, min_level
from ..operators.parsers import syslog_parser
from ..plans.pipe import pipe
from .common import ext_line, fresh_dir, logs, query, rendered, with_logs
from .inputs import written
from .parsing import LEVEL, MESSAGE

TITLE = "coalesce(upper(level[1]) || lower(level[2:]), '')"


def _fractional(spark, sf_dir):
    return logs(spark, sf_dir).withColumn("message", F.concat("message", F.lit(', "said"')))


RFC = """CASE WHEN epoch_us("timestamp") % 1000000 = 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '+00:00'
  WHEN epoch_us("timestamp") % 1000 = 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' ELSE strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END"""


@query("k1_write_raw", with_logs("SELECT raw AS line FROM logs"))
def k1(spark, sf_dir):
    path = fresh_dir(spark, "raw")
    si.write_raw(logs(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "k2_write_json",
    with_logs(
        f"""SELECT '{{"component":"' || component_name || '","hostname":"' || hostname || '","level":"' || {TITLE} || '","message":"' || message || ', \\"said\\"","pid":"' || pid || '","timestamp":"' || {RFC} || '"}}' AS line FROM logs"""
    ),
)
def k2(spark, sf_dir):
    path = fresh_dir(spark, "json")
    si.write_json(_fractional(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "k3_write_csv",
    with_logs(
        f"""SELECT {RFC} || ',' || {TITLE} || ',' || hostname || ',' || component_name || ',' || pid || ',"' || message || ', ""said""' || '"' AS line FROM logs"""
    ),
)
def k3(spark, sf_dir):
    path = fresh_dir(spark, "csv")
    si.write_csv(_fractional(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line")).filter("line NOT LIKE 'timestamp,%'")


@query(
    "k4_write_yaml",
    with_logs(
        f"""SELECT unnest(['---', 'level: "' || {TITLE} || '"', 'msg: "' || message || ', \\"said\\""']) AS line FROM logs"""
    ),
)
def k4(spark, sf_dir):
    path = fresh_dir(spark, "yaml")
    si.write_yaml(_fractional(spark, sf_dir), path, ["level", "msg"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "k5_write_records",
    with_logs("""SELECT id, "timestamp", level, source, pid, component_name, hostname, context, message, raw, k FROM logs"""),
)
def k5(spark, sf_dir):
    path = fresh_dir(spark, "records")
    df = logs(spark, sf_dir)
    si.write_records(df, path)
    back = spark.read.schema(df.schema).option("timestampFormat", si.RECORD_TIME).json(path)
    return back.select(
        "id", "timestamp", "level", "source", "pid", "component_name", "hostname", "context", "message", "raw",
        F.try_element_at("metadata", F.lit("k")).alias("k"),
    )


@query(
    "k5_write_records_yaml",
    with_logs("""SELECT '- id: ' || id AS line FROM logs UNION ALL SELECT '  message: "' || message || '"' FROM logs
        UNION ALL SELECT '  pid: ' || coalesce(CAST(pid AS VARCHAR), 'null') FROM logs"""),
)
def k5y(spark, sf_dir):
    """Records as YAML list items; three of their lines are looked at."""
    path = fresh_dir(spark, "records-yaml")
    si.write_records(logs(spark, sf_dir), path, "yaml")
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.filter(F.col("line").rlike("^(?:- id|  message|  pid): "))


@query(
    "k6_pipe",
    f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, {LEVEL} AS level, {MESSAGE} AS msg FROM events
        WHERE event_type IN ('error', 'signup', 'view') AND ({MESSAGE} LIKE '%value=1%' OR user_id < 30)""",
)
def k6(spark, sf_dir):
    out = fresh_dir(spark, "pipe")
    pipe(
        spark,
        f"{written(spark, sf_dir, 'text')}/part-*",
        filters=["message LIKE '%value=1%'", {"field": "pid", "op": "<", "value": "30"}],
        level="NOTICE",
        fmt="json",
        fields=["time", "level", "msg"],
        out=out,
    )
    back = spark.read.schema("time string, level string, msg string").json(out)
    return back.select(
        F.substring("time", 1, 19).alias("at"), F.upper(F.nullif("level", F.lit(""))).alias("level"), "msg"
    )


@query(
    "k6_pipe_flagship",
    f"""SELECT level, count(*) AS records FROM (SELECT {LEVEL} AS level, {MESSAGE} AS message FROM events)
        WHERE (level IN ('INFO', 'NOTICE', 'ERROR') OR level IS NULL) AND NOT message LIKE '%value=9%'
          AND (message LIKE '%value=%' AND message NOT LIKE 'x%') GROUP BY level""",
)
def flagship(spark, sf_dir):
    """Events printed as syslog lines, parsed, filtered by level and message, counted by level."""
    parsed = parse_chain(rendered(spark, sf_dir, ext_line()), [syslog_parser()])
    kept = filter_set(
        min_level(to_logs(parsed), "INFO"),
        include=[{"field": "message", "op": "contains", "value": "value="}],
        exclude=[{"field": "message", "op": "contains", "value": "value=9"}],
    )
    return count_by_level(kept)
