"""Parse jobs: round trips from the event table through printed lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain as ch
from ..operators.json_log import JSON_PARSER, expand_json
from ..operators.multiline import merge_multiline
from ..operators.parsers import (
    FALLBACK_PARSER,
    OP_PARSER,
    TABLE_PARSER,
    generic_parsers,
    regex_parser,
    split_process,
    syslog_parser,
)
from ..sources.custom import register_parser, registered_parser
from ..operators.parsers import parsed
from .common import (
    DOC_LINES,
    amount,
    bsd_line,
    doc_lines,
    events,
    ext_line,
    generic_line,
    iso_line,
    json_log_line,
    message,
    op_line,
    query,
    rendered,
    table,
    table_line,
    ts_text,
)

AMOUNT = "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"
MESSAGE = f"event_type || ' value=' || {AMOUNT}"
LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'NOTICE' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' END"


def _fields(df, *names):
    return df.select("event_id", *[F.col(f"parsed.{n}").alias(n) for n in names])


@query(
    "p2_syslog_bsd",
    f"""SELECT event_id, date_trunc('second', ts) AS "timestamp", CAST(NULL AS VARCHAR) AS level, 'host' || (user_id % 20) AS hostname,
       'app' AS process_name, user_id AS pid, {MESSAGE} AS message FROM events""",
)
def p2(spark, sf_dir):
    rows = ch.parse_chain(rendered(spark, sf_dir, bsd_line()), [syslog_parser("B")])
    return _fields(rows, "timestamp", "level", "hostname", "process_name", "pid", "message")


@query(
    "p3_syslog_ext",
    f"""SELECT event_id, ts AS "timestamp", {LEVEL} AS level, 'host' || (user_id % 20) AS hostname, 'web' AS container,
       'app' AS process_name, user_id AS pid, {MESSAGE} AS message FROM events""",
)
def p3(spark, sf_dir):
    rows = ch.parse_chain(rendered(spark, sf_dir, ext_line()), [syslog_parser("E")])
    return _fields(rows, "timestamp", "level", "hostname", "container", "process_name", "pid", "message")


@query(
    "p4_syslog_iso",
    f"""SELECT event_id, ts - INTERVAL 2 HOUR AS "timestamp", 'host' || (user_id % 20) AS hostname,
       event_type AS process_name, CAST(NULL AS BIGINT) AS pid, {MESSAGE} AS message FROM events""",
)
def p4(spark, sf_dir):
    rows = ch.parse_chain(rendered(spark, sf_dir, iso_line()), [syslog_parser("I")])
    return _fields(rows, "timestamp", "hostname", "process_name", "pid", "message")


@query(
    "p5_split_process",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'c' || (user_id % 5) END AS container, event_type AS process_name,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN user_id WHEN 1 THEN NULL ELSE NULL END AS pid FROM events""",
)
def p5(spark, sf_dir):
    user, kind = F.col("user_id").cast("string"), F.col("event_id")
    part = F.concat(
        F.when(kind % 2 == 0, F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string"), F.lit("#"))).otherwise(F.lit("")),
        F.col("event_type"),
        F.when(kind % 3 == 0, F.concat(F.lit("["), user, F.lit("]")))
        .when(kind % 3 == 1, F.concat(F.lit("[x"), user, F.lit("]")))
        .otherwise(F.lit("")),
    )
    rows = events(spark, sf_dir).select("event_id", split_process(part).alias("p"))
    return rows.select("event_id", "p.container", "p.process_name", "p.pid")


@query(
    "p6_table_log",
    f"""SELECT event_id, ts AS "timestamp", 'USER_TABLE' AS component_name, 'u' || user_id AS context,
       CASE event_type WHEN 'error' THEN 'DEL' ELSE 'SET' END AS "function",
       CASE event_type WHEN 'error' THEN '' ELSE 'type:' || event_type || '|value:' || {AMOUNT} END AS message FROM events""",
)
def p6(spark, sf_dir):
    rows = ch.parse_chain(rendered(spark, sf_dir, table_line()), [TABLE_PARSER])
    return _fields(rows, "timestamp", "component_name", "context", "function", "message")


OPS = f"""ops AS (SELECT event_id, user_id, event_type, ts AS "timestamp", CASE event_type WHEN 'error' THEN 'NOTICE' ELSE 'INFO' END AS level,
    CASE event_type WHEN 'view' THEN 'PORT' WHEN 'click' THEN 'SWITCH' END AS component_name,
    CASE WHEN event_type IN ('view', 'click') THEN 'oid:0x' || user_id END AS context,
    CASE event_type WHEN 'view' THEN 'Get' WHEN 'purchase' THEN 'GetResponse' WHEN 'click' THEN 'Query: avail'
      WHEN 'signup' THEN 'QueryResponse: avail' ELSE 'Notification: port_state' END AS function,
    CASE event_type WHEN 'view' THEN 'SPEED=0' WHEN 'purchase' THEN 'STATUS_OK|SPEED=' || {AMOUNT} WHEN 'click' THEN 'N=1'
      WHEN 'signup' THEN 'STATUS=OK|N=' || {AMOUNT} ELSE '[{{"u":' || user_id || '}}]' END AS message FROM events)"""


@query(
    "p7_op_log",
    f"""WITH {OPS} SELECT event_id, "timestamp", level, component_name, context, function, message FROM ops""",
)
def p7(spark, sf_dir):
    rows = ch.parse_chain(rendered(spark, sf_dir, op_line()), [OP_PARSER])
    return _fields(rows, "timestamp", "level", "component_name", "context", "function", "message")


CARRIED = OPS + """, carried AS (SELECT event_id, function, message,
    CASE event_type WHEN 'purchase' THEN last_value(CASE WHEN event_type = 'view' THEN context END IGNORE NULLS) OVER w
      WHEN 'signup' THEN last_value(CASE WHEN event_type = 'click' THEN context END IGNORE NULLS) OVER w ELSE context END AS context,
    CASE event_type WHEN 'purchase' THEN last_value(CASE WHEN event_type = 'view' THEN component_name END IGNORE NULLS) OVER w
      WHEN 'signup' THEN last_value(CASE WHEN event_type = 'click' THEN component_name END IGNORE NULLS) OVER w ELSE component_name END AS component_name
    FROM ops WINDOW w AS (PARTITION BY user_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _carried(spark, sf_dir):
    source = F.concat(F.lit("ops-"), (F.col("user_id") % 3).cast("string"))
    lines = rendered(spark, sf_dir, op_line(), source)
    rows = ch.parse_chain(lines, [OP_PARSER]).select("event_id", "source", "block_start", "seq", "parser", "parsed.*")
    return ch.carry_request_context(rows)


@query("p8_carry_context", f"WITH {CARRIED} SELECT event_id, function, context, component_name FROM carried")
def p8(spark, sf_dir):
    return _carried(spark, sf_dir).select("event_id", "function", "context", "component_name")


@query(
    "p8_carry_conversations",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN CAST(length(text) AS VARCHAR)
         ELSE last_value(CASE WHEN role = 'user' THEN CAST(length(text) AS VARCHAR) END IGNORE NULLS)
              OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS context FROM conversations""",
)
def p8b(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.col("conv_id").cast("string").alias("source"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "Get").otherwise("GetResponse").alias("function"),
        F.when(F.col("role") == "user", F.length("text").cast("string")).alias("context"),
        F.lit(None).cast("string").alias("component_name"),
    )
    return ch.carry_request_context(rows).select("conv_id", "turn", "context")


@query(
    "p9_expand_attributes",
    f"""WITH {CARRIED}, v AS (SELECT c.*, user_id, event_type, {AMOUNT} AS amt FROM carried c JOIN events USING (event_id))
    SELECT event_id, path, value FROM (
      SELECT event_id, 'Operation' AS path, function AS value FROM v
      UNION ALL SELECT event_id, 'Object Type', component_name FROM v UNION ALL SELECT event_id, 'OID', context FROM v
      UNION ALL SELECT event_id, 'Status', CASE event_type WHEN 'purchase' THEN 'STATUS_OK' WHEN 'signup' THEN 'OK' END FROM v
      UNION ALL SELECT event_id, 'Attributes.SPEED', CASE event_type WHEN 'view' THEN '0' WHEN 'purchase' THEN amt END FROM v
      UNION ALL SELECT event_id, 'Attributes.N', CASE event_type WHEN 'click' THEN '1' WHEN 'signup' THEN amt END FROM v
      UNION ALL SELECT event_id, 'Attributes.[{{"u":' || user_id || '}}]', CASE event_type WHEN 'error' THEN '' END FROM v
      UNION ALL SELECT event_id, 'Request Context', CASE WHEN event_type IN ('purchase', 'signup') THEN context END FROM v) WHERE value IS NOT NULL""",
)
def p9(spark, sf_dir):
    rows = ch.expand_attributes(_carried(spark, sf_dir))
    return rows.select("event_id", F.explode("expanded").alias("leaf")).select("event_id", "leaf.path", "leaf.value")


@query(
    "p9_expand_table",
    f"""SELECT event_id, path, value FROM (
      SELECT event_id, 'Operation' AS path, CASE event_type WHEN 'error' THEN 'DEL' ELSE 'SET' END AS value FROM events
      UNION ALL SELECT event_id, 'Table', 'USER_TABLE' FROM events UNION ALL SELECT event_id, 'Key', 'u' || user_id FROM events
      UNION ALL SELECT event_id, 'Attributes.type', event_type FROM events WHERE event_type <> 'error'
      UNION ALL SELECT event_id, 'Attributes.value', {AMOUNT} FROM events WHERE event_type <> 'error')""",
)
def p9b(spark, sf_dir):
    rows = ch.parse_chain(rendered(spark, sf_dir, table_line()), [TABLE_PARSER]).select("event_id", "parser", "parsed.*")
    leaves = ch.expand_attributes(rows).select("event_id", F.explode("expanded").alias("leaf"))
    return leaves.select("event_id", "leaf.path", "leaf.value")


@query(
    "p10_json_log",
    f"""SELECT event_id, ts AS "timestamp", {LEVEL} AS level, {MESSAGE} AS message, 'host' || (user_id % 20) AS hostname,
       event_type AS component_name, user_id AS pid, '{{"n":' || event_id || ',"tags":["a","' || event_type || '"],"v":' || value || ',"w":' || round(value) || '}}' AS data FROM events""",
)
def p10(spark, sf_dir):
    rows = ch.parse_chain(rendered(spark, sf_dir, json_log_line()), [JSON_PARSER])
    return _fields(rows, "timestamp", "level", "message", "hostname", "component_name", "pid", "metadata").select(
        "*", F.try_element_at("metadata", F.lit("data")).alias("data")
    ).drop("metadata")


@query(
    "p11_expand_json",
    """SELECT event_id, 'Payload.data.n' AS path, CAST(event_id AS VARCHAR) AS value FROM events
       UNION ALL SELECT event_id, 'Payload.data.v', CAST(value AS VARCHAR) FROM events UNION ALL SELECT event_id, 'Payload.data.w', CAST(round(value) AS VARCHAR) FROM events
       UNION ALL SELECT event_id, 'Payload.data.tags[0]', 'a' FROM events UNION ALL SELECT event_id, 'Payload.data.tags[1]', event_type FROM events""",
)
def p11(spark, sf_dir):
    rows = rendered(spark, sf_dir, json_log_line()).select("event_id", F.explode(expand_json(F.col("line"))).alias("leaf"))
    return rows.select("event_id", "leaf.path", "leaf.value")


_CUSTOM = r"^(?P<timestamp>\d+/\d+/\d+ \d+:\d+:\d+) <(?P<level>\w+)> (?P<process>\w+)(?:\[(?P<pid>\d+)\])? (?P<user_key>u\d+) - (?P<message>.*)$"


@query(
    "p12_regex",
    f"""SELECT event_id, date_trunc('second', ts) AS "timestamp", {LEVEL.replace("END", "ELSE NULL END")} AS level, event_type AS process_name,
       CASE WHEN event_id % 2 = 0 THEN user_id END AS pid, 'u' || user_id AS user_key, {MESSAGE} AS message FROM events""",
)
def p12(spark, sf_dir):
    level = (
        F.when(F.col("event_type") == "error", "err").when(F.col("event_type") == "signup", "Notice")
        .when(F.col("event_type") == "purchase", "INF").when(F.col("event_type") == "click", "dbg").otherwise("none")
    )
    user = F.col("user_id").cast("string")
    line = F.concat(
        ts_text("dd/MM/yyyy HH:mm:ss"), F.lit(" <"), level, F.lit("> "), F.col("event_type"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), user, F.lit("]"))).otherwise(F.lit("")),
        F.lit(" u"), user, F.lit(" - "), message(),
    )
    rows = ch.parse_chain(rendered(spark, sf_dir, line), [regex_parser("custom", _CUSTOM, "%d/%m/%Y %H:%M:%S")])
    out = _fields(rows, "timestamp", "level", "process_name", "pid", "metadata", "message")
    return out.withColumn("user_key", F.try_element_at("metadata", F.lit("user_key"))).drop("metadata")


@query(
    "p13_generic",
    f"""SELECT event_id, date_trunc('second', ts) AS "timestamp",
       CASE CAST(event_id % 3 AS INT) WHEN 1 THEN 'WARN' ELSE coalesce({LEVEL}, 'WARN') END AS level, {MESSAGE} AS message,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'iso_level' WHEN 1 THEN 'iso_bracket_level' ELSE 'level_iso' END AS parser FROM events""",
)
def p13(spark, sf_dir):
    level = F.regexp_extract(generic_line(), r"^\S+ \S+ (\S+)", 1)
    stamp = ts_text("yyyy-MM-dd HH:mm:ss")
    line = (
        F.when(F.col("event_id") % 3 == 0, generic_line())
        .when(F.col("event_id") % 3 == 1, F.concat(ts_text("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" [wrn] "), message()))
        .otherwise(F.concat(level, F.lit("  "), stamp, F.lit(" "), message()))
    )
    rows = ch.parse_chain(rendered(spark, sf_dir, line), generic_parsers())
    return rows.select("event_id", "parsed.timestamp", "parsed.level", "parsed.message", "parser")


@query(
    "p14_fallback",
    "WITH " + DOC_LINES + """ SELECT doc_id, seq, line AS message, TIMESTAMP '2024-06-01 00:00:00' AS "timestamp" FROM doc_lines WHERE length(line) > 0""",
)
def p14(spark, sf_dir):
    rows = ch.parse_chain(doc_lines(spark, sf_dir), [FALLBACK_PARSER]).select("*")
    logs = ch.to_logs(rows.withColumn("loader_id", F.col("doc_id").cast("string")), "2024-06-01T00:00:00Z")
    return logs.select(F.col("loader_id").cast("bigint").alias("doc_id"), "seq", "message", "timestamp")


def _mixed_line():
    kind = F.col("event_type")
    return (
        F.when(kind == "view", bsd_line())
        .when(kind == "purchase", ext_line())
        .when(kind == "click", generic_line())
        .when(kind == "signup", json_log_line())
        .otherwise(F.concat(F.lit("?? "), message()))
    )


@query(
    "p15_parse_chain",
    f"""SELECT event_id, {MESSAGE} AS message, CASE event_type WHEN 'view' THEN 'syslog' WHEN 'purchase' THEN 'syslog'
       WHEN 'click' THEN 'iso_level' WHEN 'signup' THEN 'json' ELSE 'fallback' END AS parser FROM events WHERE event_type <> 'error'
       UNION ALL SELECT event_id, '?? ' || {MESSAGE}, 'fallback' FROM events WHERE event_type = 'error'""",
)
def p15(spark, sf_dir):
    parsers = [JSON_PARSER, syslog_parser(), *generic_parsers(), FALLBACK_PARSER]
    rows = ch.parse_chain(rendered(spark, sf_dir, _mixed_line()), parsers)
    return rows.select("event_id", "parsed.message", "parser")


@query(
    "p16_failed_lines",
    f"""SELECT '?? ' || {MESSAGE} AS raw, 'events.log' AS source FROM events WHERE event_type = 'error'""",
)
def p16(spark, sf_dir):
    rows = ch.parse_chain(rendered(spark, sf_dir, _mixed_line()), [JSON_PARSER, syslog_parser(), *generic_parsers()])
    return ch.failed_lines(rows).select("raw", "source")


@query(
    "p17_merge_multiline",
    "WITH " + DOC_LINES + """, t AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY seq), 0) AS block FROM doc_lines)
       SELECT 'doc-' || doc_id AS source, min(seq) AS seq, string_agg(line, ' / ' ORDER BY seq) AS line, count(*) AS n_lines FROM t GROUP BY doc_id, block""",
)
def p17(spark, sf_dir):
    merged = merge_multiline(doc_lines(spark, sf_dir).drop("doc_id"), "^[A-M]", " / ")
    return merged.select("source", "seq", "line", "n_lines")


@query(
    "p21_precise_syslog",
    f"""SELECT event_id, ts + INTERVAL 8 HOUR AS "timestamp", 'host' || (user_id % 20) AS hostname, event_type AS process_name, {MESSAGE} AS message FROM events""",
)
def p21(spark, sf_dir):
    precise = F.concat(ts_text("yyyy-MM-dd HH:mm:ss.SSSSSS"), F.substr(iso_line("-08:00"), F.lit(27)))
    line = F.when(F.col("event_id") % 2 == 0, precise).otherwise(
        F.concat(ts_text("yyyy-MM-dd HH:mm:ss"), F.lit(" "), iso_line("-08:00"))
    )
    rows = ch.parse_chain(rendered(spark, sf_dir, line), [syslog_parser("I", precise=True)])
    return _fields(rows, "timestamp", "hostname", "process_name", "message")


def _format_line():
    kind = F.col("event_type")
    return (
        F.when(kind == "error", op_line()).when(kind == "signup", table_line()).when(kind == "view", ext_line())
        .when(kind == "click", json_log_line()).otherwise(generic_line())
    )


def format_source():
    return F.concat("event_type", F.lit("-"), (F.col("user_id") % 5).cast("string"), F.lit(".log"))


@query(
    "p1_detect_formats",
    """SELECT DISTINCT event_type || '-' || (user_id % 5) || '.log' AS source, CASE event_type WHEN 'error' THEN 'op_log' WHEN 'signup' THEN 'table_log'
       WHEN 'view' THEN 'syslog' WHEN 'click' THEN 'json' ELSE 'generic' END AS format FROM events""",
)
def p1(spark, sf_dir):
    return ch.detect_formats(rendered(spark, sf_dir, _format_line(), format_source()))


@query(
    "x10_explode_attrs",
    f"""SELECT event_id, pos, path, label, value, depth FROM (
      SELECT event_id, 0 AS pos, 'Operation' AS path, 'Operation' AS label, CASE event_type WHEN 'error' THEN 'DEL' ELSE 'SET' END AS value, 0 AS depth FROM events
      UNION ALL SELECT event_id, 1, 'Table', 'Table', 'USER_TABLE', 0 FROM events UNION ALL SELECT event_id, 2, 'Key', 'Key', 'u' || user_id, 0 FROM events
      UNION ALL SELECT event_id, 3, 'Attributes.type', 'type', event_type, 1 FROM events WHERE event_type <> 'error'
      UNION ALL SELECT event_id, 4, 'Attributes.value', 'value', {AMOUNT}, 1 FROM events WHERE event_type <> 'error')""",
)
def x10(spark, sf_dir):
    from ..operators.projection import explode_attrs

    rows = ch.parse_chain(rendered(spark, sf_dir, table_line()), [TABLE_PARSER]).select("event_id", "parser", "parsed.*")
    return explode_attrs(ch.expand_attributes(rows), keep=["event_id"])


@query(
    "x12_split_attributes",
    "SELECT event_id, 'type' AS label, event_type AS value FROM events UNION ALL SELECT event_id, 'value', CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) FROM events",
)
def x12(spark, sf_dir):
    text = F.concat(F.lit("type="), F.col("event_type"), F.lit("|value="), amount())
    leaves = events(spark, sf_dir).select("event_id", F.explode(ch._attributes(text, "=", False)).alias("a"))
    return leaves.select("event_id", "a.label", "a.value")


@query(
    "e1_custom_parser",
    f"""SELECT event_id, event_type AS component_name, CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'pairs' END AS parser
        FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL, 'fallback' FROM events WHERE event_type = 'error'""",
)
def e1(spark, sf_dir):
    def pairs(line):
        kind = F.regexp_extract(line, r"^kind=(\w+);", 1)
        return F.when(kind != "", parsed(component_name=kind, message=line))

    register_parser("pairs", pairs)
    line = F.when(F.col("event_type") == "error", F.lit("no pairs here")).otherwise(
        F.concat(F.lit("kind="), F.col("event_type"), F.lit(";"))
    )
    rows = ch.parse_chain(rendered(spark, sf_dir, line), [registered_parser("pairs"), FALLBACK_PARSER])
    return rows.select("event_id", "parsed.component_name", "parser")
