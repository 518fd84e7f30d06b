"""Order, identity, time and position lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as od
from ..operators import search as se
from ..plans import segments as sg
from ..sources.tables import as_logs
from .common import events, logs, query, store, table, with_logs, with_store


@query(
    "s9_as_logs",
    """SELECT o_orderkey AS id, o_orderdate AS "timestamp", CASE o_orderstatus WHEN 'F' THEN 'FATAL' WHEN 'O' THEN 'INFO' ELSE 'WARN' END AS level,
       CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'O' THEN 2 ELSE 4 END AS level_rank, o_custkey AS pid, CAST(NULL AS BIGINT) AS tid,
       o_orderpriority AS component_name, 'order ' || o_orderkey AS message, 'order ' || o_orderkey AS raw, 'orders' AS source, 'orders' AS loader_id FROM orders""",
)
def s9(spark, sf_dir):
    level = F.when(F.col("o_orderstatus") == "F", "FATAL").when(F.col("o_orderstatus") == "O", "INFO").otherwise("WARN")
    return as_logs(
        table(spark, sf_dir, "orders"),
        {
            "id": "o_orderkey",
            "timestamp": "o_orderdate",
            "level": level,
            "pid": "o_custkey",
            "component_name": "o_orderpriority",
            "message": F.concat(F.lit("order "), F.col("o_orderkey").cast("string")),
            "source": F.lit("orders"),
        },
    ).select("id", "timestamp", "level", "level_rank", "pid", "tid", "component_name", "message", "raw", "source", "loader_id")


def _orders(spark, sf_dir):
    """Orders as logs: many share a time, and arrival order is not time order."""
    return as_logs(
        table(spark, sf_dir, "orders"),
        {"id": "o_orderkey", "timestamp": "o_orderdate", "level": F.lit("INFO"), "source": F.lit("orders"),
         "message": "o_orderpriority", "pid": "o_custkey"},
    )


@query("r1_order_by_time", """SELECT o_orderkey AS id, o_orderdate AS "timestamp" FROM orders ORDER BY o_orderdate, o_orderkey""")
def r1(spark, sf_dir):
    return od.order_by_time(_orders(spark, sf_dir)).select("id", "timestamp")


@query(
    "r2_record_index",
    """SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS record_index FROM orders""",
)
def r2(spark, sf_dir):
    return od.with_record_index(_orders(spark, sf_dir)).select("id", "record_index")


@query("r2_record_at", with_store("SELECT id, message FROM store WHERE record_index = 777"))
def r2b(spark, sf_dir):
    return od.record_at(store(spark, sf_dir), 777).select("id", "message")


@query(
    "r3_find_by_timestamp",
    """SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-15 03:04:05') AS record_index FROM events""",
)
def r3(spark, sf_dir):
    return od.find_by_timestamp(logs(spark, sf_dir), "2024-01-15T03:04:05Z")


@query("r4_range_by_index", with_store("SELECT id, record_index FROM store WHERE record_index >= 9000 AND record_index < 12000"))
def r4(spark, sf_dir):
    return od.range_by_index(store(spark, sf_dir), 9000, 12000).select("id", "record_index")


@query(
    "r5_assign_ids",
    """SELECT line_id, row_number() OVER (ORDER BY source, seq) - 1 AS id FROM
       (SELECT event_id AS line_id, 'f' || (user_id % 3) AS source, event_id AS seq FROM events)""",
)
def r5(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        F.col("event_id").alias("line_id"),
        F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("source"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("event_id").alias("seq"),
    )
    return od.assign_ids(rows).select("line_id", "id")


@query("r6_record_count", "SELECT count(*) AS records, count(*) = 0 AS is_empty FROM events")
def r6(spark, sf_dir):
    return od.record_count(logs(spark, sf_dir))


@query(
    "r7_out_of_order",
    """SELECT o_orderkey AS id, coalesce(o_orderdate < max(o_orderdate) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM orders""",
)
def r7(spark, sf_dir):
    return od.flag_out_of_order(_orders(spark, sf_dir)).select("id", "out_of_order")


@query(
    "r8_jump_relative",
    with_store(
        """SELECT a.record_index AS anchor_index, a."timestamp" + INTERVAL 5400 SECOND AS target_ts,
             CASE WHEN n.record_index IS NULL OR (p.record_index IS NOT NULL AND
               (epoch_us(a."timestamp" + INTERVAL 5400 SECOND) - epoch_us(p."timestamp")) // 1000
               <= (epoch_us(n."timestamp") - epoch_us(a."timestamp" + INTERVAL 5400 SECOND)) // 1000) THEN p.record_index ELSE n.record_index END AS record_index
           FROM store a
           ASOF LEFT JOIN store p ON a."timestamp" + INTERVAL 5400 SECOND > p."timestamp"
           ASOF LEFT JOIN store n ON a."timestamp" + INTERVAL 5400 SECOND <= n."timestamp" """
    ),
)
def r8(spark, sf_dir):
    df = store(spark, sf_dir)
    return od.jump_relative(df, df, "1h30m").select("anchor_index", "target_ts", "record_index")


@query(
    "r10_nearest_preceding",
    with_store(
        """SELECT id, coalesce(max(CASE WHEN level = 'ERROR' THEN record_index END) OVER (ORDER BY record_index),
             min(CASE WHEN level = 'ERROR' THEN record_index END) OVER ()) AS nearest_index FROM store"""
    ),
)
def r10(spark, sf_dir):
    passing = F.coalesce(F.col("level") == "ERROR", F.lit(False))
    return od.nearest_preceding(store(spark, sf_dir), passing).select("id", "nearest_index")


@query(
    "r11_page",
    """SELECT o_orderkey AS id, o_orderdate AS "timestamp" FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 1234""",
)
def r11(spark, sf_dir):
    return od.page(_orders(spark, sf_dir), 1234, 50).select("id", "timestamp")


@query(
    "r11_view_index",
    with_store("SELECT id, row_number() OVER (ORDER BY record_index) - 1 AS view_index FROM store WHERE level = 'INFO'"),
)
def r11b(spark, sf_dir):
    return od.with_view_index(store(spark, sf_dir), F.col("level") == "INFO").select("id", "view_index")


@query(
    "q3_next_from_position",
    with_store(
        """SELECT coalesce(min(record_index) FILTER (record_index >= 9990), min(record_index)) AS record_index FROM store WHERE message LIKE '%value=77%'"""
    ),
)
def q3b(spark, sf_dir):
    return se.next_match(store(spark, sf_dir), F.col("message").contains("value=77"), 9990)


@query(
    "x1_select_fields",
    with_logs(
        """SELECT strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS time_s, coalesce(upper(level[1]) || lower(level[2:]), '') AS severity, hostname AS host,
           component_name AS service, CAST(pid AS VARCHAR) AS pid, message AS msg, coalesce(context, '') AS context, '' AS nothing, k FROM logs"""
    ),
)
def x1(spark, sf_dir):
    from ..operators.projection import select_fields

    out = select_fields(logs(spark, sf_dir), ["time", "severity", "host", "service", "pid", "msg", "context", "nothing", "k"])
    return out.select(F.substring("time", 1, 19).alias("time_s"), *[c for c in out.columns if c != "time"])


@query(
    "x11_unpivot_fields",
    with_logs(
        """SELECT id, field, value FROM (
          SELECT id, 'Timestamp' AS field, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%g') AS value FROM logs
          UNION ALL SELECT id, 'Level', coalesce(level, '-') FROM logs UNION ALL SELECT id, 'Source', source FROM logs
          UNION ALL SELECT id, 'Hostname', hostname FROM logs UNION ALL SELECT id, 'Context', context FROM logs
          UNION ALL SELECT id, 'Component', component_name FROM logs UNION ALL SELECT id, 'PID', CAST(pid AS VARCHAR) FROM logs
          UNION ALL SELECT id, 'Meta', 'k = ' || k FROM logs) WHERE value IS NOT NULL"""
    ),
)
def x11(spark, sf_dir):
    from ..operators.projection import unpivot_fields

    return unpivot_fields(logs(spark, sf_dir)).select("id", "field", "value")


_FENCED: dict[tuple[str, str], sg.Store] = {}


def fenced(spark, sf_dir: str) -> sg.Store:
    """The events in time order as files with fences, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FENCED:
        _FENCED[key] = sg.write_store(logs(spark, sf_dir), ("timestamp", "id"))
    return _FENCED[key]


@query("r3_fenced_lookup", """SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-15 03:04:05') AS record_index FROM events""")
def r3b(spark, sf_dir):
    """The position of a time from the fences and one file."""
    return sg.find_by_time(fenced(spark, sf_dir), "2024-01-15T03:04:05Z")


@query("r4_fenced_range", with_store("SELECT id, record_index FROM store WHERE record_index >= 4900 AND record_index < 9100"))
def r4b(spark, sf_dir):
    return sg.range_by_position(fenced(spark, sf_dir), 4900, 9100).select("id", "record_index")


@query(
    "r4_fenced_times",
    with_store("""SELECT id, record_index FROM store WHERE "timestamp" >= TIMESTAMP '2024-01-09 12:00:00' AND "timestamp" < TIMESTAMP '2024-01-12'"""),
)
def r4c(spark, sf_dir):
    return sg.time_slice(fenced(spark, sf_dir), "2024-01-09T12:00:00Z", "2024-01-12T00:00:00Z").select("id", "record_index")


@query("r2_fenced_positions", with_store("SELECT id, record_index FROM store"))
def r2c(spark, sf_dir):
    return sg.with_positions(fenced(spark, sf_dir)).select("id", "record_index")
