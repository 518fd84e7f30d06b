"""Streaming queries: the event table arrives in pieces."""

from __future__ import annotations

import time

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from ..operators.chain import parse_lines, to_logs
from ..operators.ordering import with_record_index
from ..plans.segments import merge_late, with_positions
from ..session import materialize
from ..streaming import follow as fo
from ..streaming import growing as gr
from ..streaming import operators as so
from ..streaming.batches import last_batch, write_batch
from ..streaming.regions import closed_regions, stream_regions
from .common import EVENTS_SCHEMA, events, ext_line, fresh_dir, query, to_log_rows, with_logs, with_store
from .filtering import CATEGORY_RULES, CATEGORY_SQL
from .parsing import LEVEL, MESSAGE
from .spans import STACK, visit_rules

_PIECES, _FILES = 3, 4
_ARRIVED: dict[tuple[str, str, str], str] = {}


def _piece(df: DataFrame, bounds: list, i: int) -> DataFrame:
    lo, hi = bounds[i], bounds[i + 1]
    out = df if lo is None else df.filter(F.col("ts") >= lo)
    return out if hi is None else out.filter(F.col("ts") < hi)


_BOUNDS = [None, "2024-01-11", "2024-01-21", None]


def arrivals(spark, sf_dir: str, kind: str) -> str:
    """A folder into which the events were put in three instalments, in time order."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _ARRIVED:
        path = fresh_dir(spark, f"arrivals-{kind}")
        for i in range(_PIECES):
            part = _piece(events(spark, sf_dir), _BOUNDS, i)
            if kind == "mixed":
                # Every instalment spans the whole time, so that most of the later ones come days late.
                part = events(spark, sf_dir).filter(F.col("event_id") % _PIECES == i)
            ordered = part.repartitionByRange(_FILES, "event_id").sortWithinPartitions("event_id")
            if kind == "lines":
                ordered.select(ext_line()).write.text(f"{path}/{i}")
            else:
                ordered.write.parquet(f"{path}/{i}")
            time.sleep(0.05)
        _ARRIVED[key] = path
    return _ARRIVED[key]


def log_stream(spark, sf_dir: str) -> DataFrame:
    path = arrivals(spark, sf_dir, "events")
    return to_log_rows(
        spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", _FILES).parquet(f"{path}/*")
    )


def run(sdf: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over what is there and give the result as a table."""
    spark = sdf.sparkSession
    base = fresh_dir(spark, label)
    out, where = f"{base}/out", f"{base}/checkpoint"
    writer = sdf.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(sdf.schema).parquet(out)
    writer.foreachBatch(lambda df, i: write_batch(df, out, i)).start().awaitTermination()
    return last_batch(spark, out, sdf.schema)


@query(
    "t1_stream_logs",
    f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, ts AS "timestamp", {LEVEL} AS level, {MESSAGE} AS message FROM events""",
)
def t1(spark, sf_dir):
    path = f"{arrivals(spark, sf_dir, 'lines')}/*"
    base = fresh_dir(spark, "follow")
    q = fo.follow(spark, path, "syslog", f"{base}/out", f"{base}/checkpoint", maxFilesPerTrigger=str(_FILES))
    q.awaitTermination()
    return fo.followed(spark, f"{base}/out").select("id", "timestamp", "level", "message")


@query(
    "t1_stream_stateless",
    f"""SELECT ts AS "timestamp", {LEVEL} AS level, {MESSAGE} AS message FROM events""",
)
def t1b(spark, sf_dir):
    path = f"{arrivals(spark, sf_dir, 'lines')}/*"
    logs = fo.stream_logs(spark, path, "syslog").select("timestamp", "level", "message")
    return run(logs, "append", "stateless")


_STEPS, _FILE_LINES = 8, 20_000


def _instalments(spark, sf_dir: str, path: str):
    """The lines of the events in files of 20,000, of which each step writes an eighth more, cut within lines."""
    number = F.floor(F.col("event_id") / _FILE_LINES).alias("file")
    line = F.struct("event_id", F.concat(ext_line(), F.lit("\n")).alias("line"))
    listed = events(spark, sf_dir).groupBy(number).agg(F.array_sort(F.collect_list(line)).alias("l"))
    whole = materialize(listed.select("file", F.encode(F.array_join(F.col("l.line"), ""), "UTF-8").alias("content")), "growing")

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, name = pafs.FileSystem.from_uri(f"{path}/{row['file']}.log")
                with files.open_output_stream(name) as f:
                    f.write(row["content"])
            yield batch.select(["file"])

    pafs.FileSystem.from_uri(path)[0].create_dir(pafs.FileSystem.from_uri(path)[1])
    for k in range(1, _STEPS + 1):
        so_far = F.floor(F.octet_length("content") * F.lit(k) / _STEPS).cast("int")
        part = whole.select("file", F.substring("content", F.lit(1), so_far).alias("content"))
        part.mapInArrow(write, "file long").write.format("noop").mode("overwrite").save()
        yield k


@query(
    "t1_growing_files",
    f"""SELECT ts AS "timestamp", {LEVEL} AS level, {MESSAGE} AS message FROM events""",
)
def t1c(spark, sf_dir):
    """The files grow by parts of lines over eight batches; what was appended is read, once."""
    base = fresh_dir(spark, "growing")
    path = base if "://" in base or base.startswith("file:") else f"file://{base}"
    for _ in _instalments(spark, sf_dir, f"{path}/in"):
        lines = gr.growing_lines(spark, f"{path}/in", blockBytes="1000000")
        writer = lines.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{base}/lines").start().awaitTermination()
    lines = spark.read.schema(lines.schema).parquet(f"{base}/lines")
    return to_logs(parse_lines(lines, "syslog")).select("timestamp", "level", "message")


@query(
    "t2_restart",
    f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS id, ts AS "timestamp", {MESSAGE} AS message FROM events""",
)
def t2(spark, sf_dir):
    """A first run over all instalments, then a second one from scratch: the same records, ids from 0 again."""
    path = f"{arrivals(spark, sf_dir, 'lines')}/*"
    first, _ = fo.restart(spark, path, "syslog", maxFilesPerTrigger="8")
    first.awaitTermination()
    again, out = fo.restart(spark, path, "syslog", maxFilesPerTrigger="4")
    again.awaitTermination()
    return fo.followed(spark, out).select("id", "timestamp", "message")


@query(
    "t3_stream_filter",
    with_logs("SELECT id, message FROM logs WHERE coalesce(level <> 'DEBUG', false) AND NOT message LIKE '%value=3%'"),
)
def t3(spark, sf_dir):
    entries = [
        ({"field": "level", "op": "!=", "value": "DEBUG"}, False),
        ({"field": "message", "op": "contains", "value": "value=3"}, True),
    ]
    return run(so.stream_filter(log_stream(spark, sf_dir), entries).select("id", "message"), "append", "filter")


@query("t3_stream_level_counts", with_logs("SELECT level, count(*) AS records FROM logs GROUP BY level"))
def t3b(spark, sf_dir):
    return run(so.stream_level_counts(log_stream(spark, sf_dir)), "complete", "levels")


@query("t4_stream_search", with_logs("SELECT id FROM logs WHERE regexp_matches(message, '(?i)ERROR VALUE=1')"))
def t4(spark, sf_dir):
    return run(so.stream_search(log_stream(spark, sf_dir), "ERROR VALUE=1").select("id"), "append", "search")


@query(
    "t5_stream_categories",
    with_logs(
        "SELECT category, records FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS category, count(*) FILTER ({p}) AS records FROM logs" for n, p in CATEGORY_SQL)
        + ") WHERE records > 0"
    ),
)
def t5(spark, sf_dir):
    return run(so.stream_categories(log_stream(spark, sf_dir), CATEGORY_RULES), "complete", "categories")


@query(
    "t5_stream_category_density",
    with_logs(
        "SELECT category, slice_start, count(*) AS records FROM ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS category, time_bucket(INTERVAL 6 HOUR, \"timestamp\", TIMESTAMP '2024-01-01') AS slice_start FROM logs WHERE {p}"
            for n, p in CATEGORY_SQL
        )
        + ") GROUP BY 1, 2"
    ),
)
def t5b(spark, sf_dir):
    return run(so.stream_categories(log_stream(spark, sf_dir), CATEGORY_RULES, "6 hours"), "complete", "category-density")


@query("t6_stream_regions", with_store("SELECT 'visit of ' || pid AS name, start_index, end_index, timed_out FROM visits", STACK))
def t6(spark, sf_dir):
    base = fresh_dir(spark, "stream-regions")
    q = stream_regions(log_stream(spark, sf_dir), visit_rules(), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return closed_regions(spark, f"{base}/out").select("name", "start_index", "end_index", "timed_out")


@query(
    "t7_lateness",
    with_logs(
        """SELECT date_trunc('day', "timestamp") AS slice_start, count(*) AS records FROM logs GROUP BY 1
           HAVING date_trunc('day', any_value("timestamp")) + INTERVAL 1 DAY <= (SELECT max("timestamp") FROM logs) - INTERVAL 10 MINUTE"""
    ),
)
def t7(spark, sf_dir):
    late = so.with_lateness(log_stream(spark, sf_dir), "10 minutes")
    return run(so.stream_density(late, "1 day"), "append", "lateness")


@query(
    "t7_late_rows",
    with_store(
        """SELECT s.id, s.record_index, coalesce(s."timestamp" < m.newest - INTERVAL 10 MINUTE, false) AS late
           FROM store s LEFT JOIN (SELECT p, max("timestamp") AS newest FROM store, (SELECT unnest([1, 2]) AS p) WHERE id % 3 < p GROUP BY p) m ON m.p = s.id % 3"""
    ),
)
def t7b(spark, sf_dir):
    """Rows that come days late are kept and put where they belong."""
    base = fresh_dir(spark, "late")
    path = arrivals(spark, sf_dir, "mixed")
    arrived = to_log_rows(spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", _FILES).parquet(f"{path}/*"))
    so.keep_late(arrived, "10m", f"{base}/out", f"{base}/checkpoint").awaitTermination()
    rows = so.merged(spark, f"{base}/out", arrived.schema)
    return with_record_index(rows).select("id", "record_index", "late")


@query(
    "t7_merged_store",
    with_store("SELECT id, record_index FROM store"),
)
def t7c(spark, sf_dir):
    """Late rows are merged into the sorted files at a threshold, the last ones here at the end; positions come from the fences."""
    base = fresh_dir(spark, "sorted")
    path = arrivals(spark, sf_dir, "mixed")
    arrived = to_log_rows(spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", _FILES).parquet(f"{path}/*"))
    order = ("timestamp", "id")
    so.keep_sorted(arrived, f"{base}/out", f"{base}/state", order, threshold=1000).awaitTermination()
    store = so.sorted_store(spark, f"{base}/state", arrived.schema)
    rest = so.waiting_rows(spark, f"{base}/state", arrived.schema)
    if not rest.isEmpty():
        store = merge_late(store, rest, order, f"{base}/out/last")
    return with_positions(store).select("id", "record_index")


@query(
    "t8_stream_density",
    with_logs("""SELECT level, time_bucket(INTERVAL 1 HOUR, "timestamp") AS slice_start, count(*) AS records FROM logs GROUP BY 1, 2"""),
)
def t8(spark, sf_dir):
    return run(so.stream_density(log_stream(spark, sf_dir), "1 hour", by="level"), "complete", "density")
