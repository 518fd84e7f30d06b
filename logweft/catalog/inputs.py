"""Sources: event lines are written as files of each kind and read back."""

from __future__ import annotations

import io
import os
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators.parsers import syslog_parser
from ..operators.chain import parse_chain
from ..sources import custom as cu
from ..sources.load import read_logs
from ..sources.otlp import read_otlp_json
from ..sources.packed import read_gzip_lines, read_zip_lines
from ..sources.text import read_lines, sample_lines
from .common import (
    DOC_LINES,
    doc_lines,
    events,
    ext_line,
    fresh_dir,
    generic_line,
    json_log_line,
    level_of,
    local_path,
    message,
    query,
)
from .parsing import LEVEL, MESSAGE

EXT_SQL = f"""strftime(ts, '%Y %b %d %H:%M:%S.%f') || ' host' || (user_id % 20) || ' ' || coalesce({LEVEL}, 'OTHER') || ' web#app[' || user_id || ']: ' || {MESSAGE}"""

_WRITTEN: dict[tuple[str, str, str], str] = {}


def written(spark, sf_dir: str, kind: str) -> str:
    """A folder of log files of one kind made from the events."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key in _WRITTEN:
        return _WRITTEN[key]
    path = fresh_dir(spark, kind)
    df = events(spark, sf_dir)
    if kind in ("zip", "gzip-suffix"):
        os.makedirs(local_path(path), exist_ok=True)
        line = df.select((F.col("event_id") % 6).alias("part"), "event_id", ext_line().alias("line"))
        made = line.repartition(6, "part").sortWithinPartitions("part", "event_id").mapInPandas(
            _archives(local_path(path), kind), "file string"
        )
        made.count()
    elif kind == "otlp":
        df.select(_otlp_document().alias("value")).filter("value IS NOT NULL").write.text(path)
    elif kind == "mixed":
        for name, cond, line, options in (
            ("a-syslog", "view", ext_line(), {}),
            ("b-json", "click", json_log_line(), {"compression": "gzip"}),
            ("c-generic", "purchase", generic_line(), {}),
            ("d-plain", "error", message(), {}),
            ("e-syslog", "signup", ext_line(), {}),
        ):
            df.filter(F.col("event_type") == cond).select(line).write.options(**options).text(f"{path}/{name}")
    else:
        options = {"compression": "gzip"} if kind == "gz" else {}
        df.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(ext_line()).write.options(
            **options
        ).text(path)
    _WRITTEN[key] = path
    return path


def _archives(folder: str, kind: str):
    """Write each part as archives of two entries (or gzip files under an unusual suffix)."""

    def run(batches):
        import gzip

        for n, batch in enumerate(batches):
            for part, rows in batch.groupby("part"):
                text = "".join(line + "\n" for line in rows["line"])
                name = f"{folder}/part-{part}-{n}"
                if kind == "zip":
                    held = io.BytesIO()
                    half = len(rows) // 2
                    lines = [line + "\n" for line in rows["line"]]
                    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                        z.writestr("first.log", "".join(lines[:half]))
                        z.writestr("sub/", "")
                        z.writestr("sub/second.log", "".join(lines[half:]))
                    with open(f"{name}.zip", "wb") as f:
                        f.write(held.getvalue())
                else:
                    with gzip.open(f"{name}.gzip", "wt") as f:
                        f.write(text)
                yield pd.DataFrame({"file": [name]})

    return run


def _otlp_document():
    """An export document per event, with one record (views lack a severity, errors a time)."""
    nanos = F.when(F.col("event_type") != "error", F.concat(F.unix_micros("ts").cast("string"), F.lit("000")))
    record = F.struct(
        nanos.alias("timeUnixNano"),
        level_of(F.col("event_type")).alias("severityText"),
        F.struct(message().alias("stringValue")).alias("body"),
    )
    scopes = F.array(F.struct(F.array(record).alias("logRecords")))
    return F.to_json(F.struct(F.array(F.struct(scopes.alias("scopeLogs"))).alias("resourceLogs")))


@query("s1_read_lines", f"SELECT {EXT_SQL} AS line FROM events")
def s1(spark, sf_dir):
    return read_lines(spark, written(spark, sf_dir, "text")).select("line")


@query("s2_read_gzip", f"SELECT {EXT_SQL} AS line FROM events")
def s2(spark, sf_dir):
    return read_lines(spark, written(spark, sf_dir, "gz")).select("line")


@query("s2_read_gzip_suffix", f"SELECT {EXT_SQL} AS line FROM events")
def s2b(spark, sf_dir):
    return read_gzip_lines(spark, written(spark, sf_dir, "gzip-suffix")).select("line")


@query("s3_read_zip", f"SELECT {EXT_SQL} AS line FROM events")
def s3(spark, sf_dir):
    return read_zip_lines(spark, written(spark, sf_dir, "zip")).select("line")


@query(
    "s5_read_logs",
    f"""SELECT row_number() OVER (ORDER BY o, event_id) - 1 AS id, * EXCLUDE (o, event_id) FROM (
         SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS o,
           CASE event_type WHEN 'purchase' THEN date_trunc('second', ts) WHEN 'error' THEN TIMESTAMP '2024-06-01' ELSE ts END AS "timestamp",
           CASE WHEN event_type <> 'error' THEN {LEVEL} END AS level, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'host' || (user_id % 20) END AS hostname,
           CASE WHEN event_type IN ('view', 'click', 'signup') THEN user_id END AS pid, {MESSAGE} AS message
         FROM events)""",
)
def s5(spark, sf_dir):
    path = written(spark, sf_dir, "mixed")
    patterns = [f"{path}/a-*/part-*", f"{path}/b-*/part-*", f"{path}/none-*", f"{path}/c-*/part-*", f"{path}/d-*/part-*", f"{path}/e-*/part-*"]
    logs = read_logs(spark, patterns, ingest_ts="2024-06-01T00:00:00Z")
    return logs.select("id", "timestamp", "level", "hostname", "pid", "message")


@query(
    "s6_otlp",
    f"""SELECT concat_ws(' ', CASE WHEN event_type <> 'error' THEN epoch_us(ts) || '000' END, {LEVEL}, {MESSAGE}) AS line,
        CASE WHEN event_type <> 'error' THEN ts END AS "timestamp", {LEVEL} AS severity FROM events""",
)
def s6(spark, sf_dir):
    docs = read_otlp_json(spark, written(spark, sf_dir, "otlp"), whole_file=False)
    return docs.select("line", "timestamp", "severity")


@query(
    "s7_sample_lines",
    "WITH " + DOC_LINES + " SELECT 'doc-' || doc_id AS source, seq, line FROM doc_lines WHERE seq < 10",
)
def s7(spark, sf_dir):
    return sample_lines(doc_lines(spark, sf_dir), 10).select("source", "seq", "line")


@query("s8_mod_year", "SELECT 2021 AS mod_year, count(*) AS lines FROM events")
def s8(spark, sf_dir):
    path = written(spark, sf_dir, "dated")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(hadoop):
        fs.setTimes(s.getPath(), 1_622_505_600_000, -1)  # June 2021
    lines = read_lines(spark, path)
    return lines.groupBy("mod_year").agg(F.count("*").alias("lines"))


@query("e5_custom_source", f"SELECT {EXT_SQL} AS line FROM events")
def e5(spark, sf_dir):
    name = cu.register_source(spark)
    path = local_path(written(spark, sf_dir, "text"))
    return spark.read.format(name).option("path", path).option("glob", "part-*").load().select("line")


@query(
    "s1_line_order",
    f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, {MESSAGE} AS message FROM events",
)
def s1b(spark, sf_dir):
    """Ids of parsed lines follow the order of the lines, over files and blocks."""
    from ..operators.chain import to_logs
    from ..operators.ordering import assign_ids

    rows = parse_chain(read_lines(spark, written(spark, sf_dir, "text")), [syslog_parser()])
    return assign_ids(to_logs(rows)).select("id", "message")
