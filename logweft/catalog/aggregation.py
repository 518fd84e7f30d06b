"""Counts, statistics, density, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.durations import fmt_duration, fmt_exact, fmt_open, parse_duration
from ..functions.levels import level_rank, level_title, normalize_level
from ..functions.text import fmt_count, json_text, render
from ..functions.timestamps import fmt_ts, parse_ts, rfc3339
from ..operators import aggregates as ag
from ..operators import categories as ca
from .common import EVENTS_SCHEMA, logs, query, table, with_logs
from .filtering import CATEGORY_RULES, CATEGORY_SQL


@query("a1_count_by_level", with_logs("SELECT level, count(*) AS records FROM logs GROUP BY level"))
def a1(spark, sf_dir):
    return ag.count_by_level(logs(spark, sf_dir))


@query(
    "a2_view_stats",
    with_logs(
        """, f AS (SELECT level, message LIKE '%value=1%' AS p FROM logs), g AS (
          SELECT false AS is_total, level, count(*) AS total, count(*) FILTER (p) AS filtered FROM f GROUP BY level
          UNION ALL SELECT true, NULL, count(*), count(*) FILTER (p) FROM f)
        SELECT *, 1.0::DOUBLE - filtered / total AS filter_rate FROM g"""
    ),
)
def a2(spark, sf_dir):
    return ag.view_stats(logs(spark, sf_dir), {"field": "message", "op": "contains", "value": "value=1"})


@query(
    "a3_level_distribution",
    with_logs(
        """SELECT level, level_rank, count(*) AS records,
           count(*) / (SELECT count(*) FROM logs) * 100.0::DOUBLE AS percent FROM logs WHERE level IS NOT NULL GROUP BY ALL"""
    ),
)
def a3(spark, sf_dir):
    return ag.level_distribution(logs(spark, sf_dir))


@query(
    "a4_top_components",
    """SELECT 'user ' || user_id AS component_name, count(*) AS records FROM events GROUP BY user_id
       ORDER BY records DESC, component_name LIMIT 10""",
)
def a4(spark, sf_dir):
    user = F.concat(F.lit("user "), F.col("pid").cast("string"))
    return ag.top_components(logs(spark, sf_dir).withColumn("component_name", user))


@query(
    "a5_time_range",
    """SELECT min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS span_ms FROM events""",
)
def a5(spark, sf_dir):
    return ag.time_range_stats(logs(spark, sf_dir))


def _bucket_sql(n: int, where: str = "true") -> str:
    return f"""b AS (SELECT min("timestamp") AS lo, max("timestamp") AS hi FROM logs WHERE {where}),
      h AS (SELECT CAST(least(floor(CAST((epoch_us("timestamp") - epoch_us(lo)) // 1000 AS DOUBLE)
                / CAST((epoch_us(hi) - epoch_us(lo)) // 1000 AS DOUBLE) * {n - 1}.0), {n - 1}) AS INT) AS bucket, logs.*
            FROM logs, b WHERE {where}),
      grid AS (SELECT CAST(unnest(range({n})) AS INT) AS bucket)"""


@query(
    "a6_density",
    with_logs(
        f""", {_bucket_sql(120)} SELECT grid.bucket, count(h.bucket) AS records FROM grid LEFT JOIN h USING (bucket) GROUP BY grid.bucket"""
    ),
)
def a6(spark, sf_dir):
    return ag.density(logs(spark, sf_dir), 120)


@query("a7_bucket_of", with_logs(f", {_bucket_sql(50)} SELECT id, bucket FROM h"))
def a7(spark, sf_dir):
    df = logs(spark, sf_dir)
    b = df.agg(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))).scalar()
    return df.select("id", ag.bucket_of(F.col("timestamp"), b["lo"], b["hi"], 50).alias("bucket"))


@query(
    "a8_density_of_level",
    with_logs(
        f""", {_bucket_sql(60, "level = 'ERROR'")} SELECT grid.bucket, count(h.bucket) AS records FROM grid LEFT JOIN h USING (bucket) GROUP BY grid.bucket"""
    ),
)
def a8(spark, sf_dir):
    return ag.density(logs(spark, sf_dir), 60, level="ERROR")


@query(
    "a8_density_of_highlight",
    with_logs(
        rf""", {_bucket_sql(60, r"regexp_matches(raw, 'value=\d\.')")} SELECT grid.bucket, count(h.bucket) AS records FROM grid LEFT JOIN h USING (bucket) GROUP BY grid.bucket"""
    ),
)
def a8h(spark, sf_dir):
    return ag.density(logs(spark, sf_dir), 60, highlight=r"value=\d\.")


@query(
    "a8_density_by_level",
    with_logs(
        f""", {_bucket_sql(40)} SELECT grid.bucket, count(h.bucket) AS all_records,
        {', '.join(f"count(*) FILTER (level = '{n}') AS {n.lower()}" for n in ('TRACE', 'DEBUG', 'INFO', 'NOTICE', 'WARN', 'ERROR', 'FATAL'))}
        FROM grid LEFT JOIN h USING (bucket) GROUP BY grid.bucket"""
    ),
)
def a8l(spark, sf_dir):
    return ag.density_by_level(logs(spark, sf_dir), 40)


@query(
    "a9_density_heights",
    with_logs(
        f""", {_bucket_sql(80)}, d AS (SELECT grid.bucket, count(h.bucket) AS records FROM grid LEFT JOIN h USING (bucket) GROUP BY grid.bucket),
        e AS (SELECT min(records) FILTER (records > 0) AS lo, max(records) AS hi FROM d)
        SELECT bucket, records, CAST(CASE WHEN records = 0 THEN 0 WHEN lo = hi THEN 2
            ELSE floor(1.5::DOUBLE + (records - lo) / CAST(hi - lo AS DOUBLE) * 3.0::DOUBLE) END AS INT) AS height FROM d, e"""
    ),
)
def a9(spark, sf_dir):
    return ag.density_heights(ag.density(logs(spark, sf_dir), 80))


@query(
    "a10_density_snapped",
    with_logs(
        """, w AS (SELECT (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 1000 / 100.0::DOUBLE AS raw_ms FROM logs),
        s AS (SELECT min(step) AS step FROM w, (SELECT unnest([1,2,5,10,20,50,100,200,500,1000,2000,5000,10000,15000,30000,60000,120000,
           300000,600000,900000,1800000,3600000,7200000,21600000,43200000,86400000]) AS step) WHERE step >= raw_ms)
        SELECT make_timestamp(epoch_us("timestamp") - epoch_us("timestamp") % (CAST(step AS BIGINT) * 1000)) AS slice_start, count(*) AS records
        FROM logs, s GROUP BY 1"""
    ),
)
def a10(spark, sf_dir):
    return ag.density_snapped(logs(spark, sf_dir), 100)


@query(
    "a10_snap_interval",
    """WITH v AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * (o_orderkey % 300) AS ms FROM orders),
       s AS (SELECT *, CASE WHEN ms <= 0 THEN 1.0::DOUBLE ELSE coalesce(list_min([x FOR x IN [1,2,5,10,20,50,100,200,500,1000,2000,5000,10000,15000,30000,60000,120000,
           300000,600000,900000,1800000,3600000,7200000,21600000,43200000,86400000] IF x >= ms])::DOUBLE, ms) END AS step_ms FROM v)
       SELECT o_orderkey, step_ms FROM s""",
)
def a10s(spark, sf_dir):
    ms = F.col("o_totalprice") * (F.col("o_orderkey") % 300)
    return table(spark, sf_dir, "orders").select("o_orderkey", ag.snap_interval(ms).alias("step_ms"))


def _category_union() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS category_ord, '{n}' AS category, count(*) FILTER ({p}) AS records, count(*) AS n FROM logs"
        for i, (n, p) in enumerate(CATEGORY_SQL)
    )


@query("a11_category_counts", with_logs(f"SELECT category_ord, category, records FROM ({_category_union()})"))
def a11(spark, sf_dir):
    return ca.category_counts(logs(spark, sf_dir), CATEGORY_RULES)


@query(
    "a12_category_density",
    with_logs(
        f""", {_bucket_sql(100)} SELECT grid.bucket, c.category_ord, c.category, CAST(sum(CASE WHEN h.bucket IS NOT NULL AND list_contains(tags, c.category_ord) THEN 1 ELSE 0 END) AS BIGINT) AS records
        FROM grid CROSS JOIN (SELECT CAST(unnest(range({len(CATEGORY_SQL)})) AS INT) AS category_ord, unnest([{', '.join(f"'{n}'" for n, _ in CATEGORY_SQL)}]) AS category) c
        LEFT JOIN (SELECT bucket, [{', '.join(f'CASE WHEN {p} THEN {i} END' for i, (_, p) in enumerate(CATEGORY_SQL))}] AS tags FROM h) h ON h.bucket = grid.bucket
        GROUP BY 1, 2, 3"""
    ),
)
def a12(spark, sf_dir):
    return ca.category_density(logs(spark, sf_dir), CATEGORY_RULES, 100)


@query(
    "a14_resample",
    with_logs(
        f""", {_bucket_sql(100)}, d AS (SELECT grid.bucket, count(h.bucket) AS records FROM grid LEFT JOIN h USING (bucket) GROUP BY grid.bucket),
        e AS (SELECT CAST(i AS INT) AS bin, CAST(floor(i * (100 / 24.0::DOUBLE)) AS INT) AS lo, least(CAST(floor((i + 1) * (100 / 24.0::DOUBLE)) AS INT), 100) AS hi FROM range(24) t(i))
        SELECT bin, CAST(sum(records) // count(*) AS BIGINT) AS records FROM e JOIN d ON bucket >= lo AND bucket < hi GROUP BY bin"""
    ),
)
def a14(spark, sf_dir):
    return ag.resample(ag.density(logs(spark, sf_dir), 100), 24, 100)


@query(
    "a15_category_share",
    with_logs(f"SELECT category_ord, category, records, records / n AS share FROM ({_category_union()})"),
)
def a15(spark, sf_dir):
    return ca.category_counts(logs(spark, sf_dir), CATEGORY_RULES, share=True).orderBy(F.desc("records"), "category_ord")


@query("a16_count_by_source", with_logs("SELECT source, count(*) AS records FROM logs GROUP BY source"))
def a16(spark, sf_dir):
    return ag.count_by_source(logs(spark, sf_dir))


@query(
    "e4_analyzer",
    with_logs(
        """SELECT component_name, count(*) AS records, count(DISTINCT pid) AS users,
           count(*) || ' records of ' || component_name AS summary FROM logs GROUP BY component_name"""
    ),
)
def e4(spark, sf_dir):
    def analyze(df):
        n = F.count("*")
        return df.groupBy("component_name").agg(
            n.alias("records"),
            F.count_distinct("pid").alias("users"),
            F.concat(n.cast("string"), F.lit(" records of "), F.first("component_name")).alias("summary"),
        )

    return logs(spark, sf_dir).transform(analyze)


@query(
    "e3_processor",
    with_logs("SELECT upper(component_name) AS component_name, count(*) AS records FROM logs GROUP BY 1"),
)
def e3(spark, sf_dir):
    def shout(df):
        return df.withColumn("component_name", F.upper("component_name"))

    return logs(spark, sf_dir).transform(shout).groupBy("component_name").agg(F.count("*").alias("records"))


# ------------------------------------------------------------ scalar functions

_SPELLINGS = ["trace", "TRC", "Debug", "dbg", "info", "INF", "notice", "warn", "WARNING", "wrn", "err", "Error", "fatal", "FTL", "critical", "crit", "verbose", ""]
_NORMAL = ["TRACE", "TRACE", "DEBUG", "DEBUG", "INFO", "INFO", "NOTICE", "WARN", "WARN", "WARN", "ERROR", "ERROR", "FATAL", "FATAL", "FATAL", "FATAL", None, None]


@query(
    "p18_normalize_level",
    "SELECT event_id, CASE CAST(event_id % 18 AS INT) "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NORMAL) if n)
    + " END AS level FROM events",
)
def p18(spark, sf_dir):
    spelled = F.element_at(F.array(*[F.lit(s) for s in _SPELLINGS]), (F.col("event_id") % 18 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", normalize_level(spelled).alias("level"))


@query(
    "x2_rfc3339",
    """SELECT o_orderkey, strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '.250' ELSE '.000123' END || '+00:00' AS text
       FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)""",
)
def x2(spark, sf_dir):
    key = F.col("o_orderkey")
    extra = F.when(key % 3 == 0, 0).when(key % 3 == 1, 250_000).otherwise(123)
    ts = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + extra)
    return table(spark, sf_dir, "orders").select("o_orderkey", rfc3339(ts).alias("text"))


@query(
    "x3_level_text",
    with_logs("SELECT id, level_rank, upper(level[1]) || lower(level[2:]) AS title FROM logs"),
)
def x3(spark, sf_dir):
    return logs(spark, sf_dir).select(
        "id", level_rank(F.col("level")).alias("level_rank"), level_title(F.col("level")).alias("title")
    )


@query(
    "x4_fmt_ts",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS millis, strftime(ts, '%H:%M:%S') AS clock FROM events""",
)
def x4(spark, sf_dir):
    return table(spark, sf_dir, "events", EVENTS_SCHEMA).select(
        "event_id", *[fmt_ts(F.col("ts"), s).alias(s) for s in ("seconds", "millis", "clock")]
    )


@query(
    "x5_parse_duration",
    """SELECT event_id, CASE WHEN v > 0 THEN v END AS ms FROM (
         SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN user_id WHEN 1 THEN user_id * 1000
           WHEN 2 THEN 3600000 + user_id * 60000 WHEN 3 THEN user_id * 86400000 + 500 END AS v FROM events)""",
)
def x5(spark, sf_dir):
    n, kind = F.col("user_id").cast("string"), F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(n, F.lit("ms")))
        .when(kind == 1, F.concat(F.lit(" "), n, F.lit("s ")))
        .when(kind == 2, F.concat(F.lit("1h"), n, F.lit("m")))
        .when(kind == 3, F.concat(n, F.lit("d500ms")))
        .when(kind == 4, n)
        .otherwise(F.concat(n, F.lit("w")))
    )
    return table(spark, sf_dir, "events").select("event_id", parse_duration(text).alias("ms"))


@query(
    "x7_render",
    with_logs("SELECT id, 'k is ' || k || ', {other} stays' AS text FROM logs"),
)
def x7(spark, sf_dir):
    return logs(spark, sf_dir).select("id", render("k is {k}, {other} stays", F.col("metadata")).alias("text"))


@query(
    "x8_fmt_duration",
    """SELECT o_orderkey, CASE WHEN ms < 1000 THEN ms || 'ms'
         WHEN ms < 60000 THEN (ms // 1000) || '.' || (ms % 1000 // 100) || 's'
         ELSE (ms // 60000) || 'm' || (ms % 60000 // 1000) || 's' END AS text,
       CASE WHEN s >= 86400 AND s % 86400 = 0 THEN (s // 86400) || 'd' WHEN s >= 3600 AND s % 3600 = 0 THEN (s // 3600) || 'h'
         WHEN s >= 60 AND s % 60 = 0 THEN (s // 60) || 'm' ELSE s || 's' END AS exact, '>' || (ms // 1000) || 's' AS open
       FROM (SELECT o_orderkey, (o_orderkey * 700) % 200000 AS ms, o_orderkey % 400 * 30 AS s FROM orders)""",
)
def x8(spark, sf_dir):
    ms, s = F.col("o_orderkey") * 700 % 200_000, F.col("o_orderkey") % 400 * 30
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fmt_duration(ms).alias("text"), fmt_exact(s).alias("exact"), fmt_open(ms).alias("open")
    )


@query(
    "x9_fmt_count",
    "SELECT l_orderkey, l_linenumber, format('{:,}', CAST(l_orderkey * 1000 + l_partkey AS BIGINT)) AS text FROM lineitem",
)
def x9(spark, sf_dir):
    n = F.col("l_orderkey") * 1000 + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fmt_count(n).alias("text"))


@query(
    "x13_json_text",
    """SELECT event_id, CAST(k AS VARCHAR) AS number_text, event_type AS string_text, 'null' AS null_text,
       CAST(value AS VARCHAR) AS fraction_text, CAST(round(value) AS VARCHAR) AS whole_text, '[' || round(value) || ',{"x":' || value || '}]' AS nested_text,
       '[' || k || ',"' || event_type || '"]' AS list_text FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
)
def x13(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    doc = F.try_parse_json(
        F.concat(F.lit('{"n":'), k, F.lit(',"s":"'), F.col("event_type"), F.lit('","z":null,"l":['), k, F.lit(',"'), F.col("event_type"), F.lit('"]}'))
    )
    value, whole = F.col("value").cast("string"), F.round("value").cast("string")
    numbers = F.try_parse_json(F.concat(F.lit('{"f":'), value, F.lit(',"w":'), whole, F.lit(',"o":['), whole, F.lit(',{"x":'), value, F.lit("}]}")))
    df = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"), numbers.alias("numbers"))
    item = lambda key, c="doc": json_text(F.try_variant_get(c, f"$.{key}", "variant"))
    return df.select(
        "event_id",
        item("n").alias("number_text"),
        item("s").alias("string_text"),
        item("z").alias("null_text"),
        item("l").alias("list_text"),
        item("f", "numbers").alias("fraction_text"),
        item("w", "numbers").alias("whole_text"),
        item("o", "numbers").alias("nested_text"),
    )


@query(
    "p19_parse_ts",
    """SELECT event_id, ts AS precise, date_trunc('second', ts) AS plain, date_trunc('second', ts) AS custom,
       date_trunc('second', ts) - INTERVAL 90 MINUTE AS zoned, date_trunc('second', ts) AS bsd, CAST(NULL AS TIMESTAMP) AS bad FROM events""",
)
def p19(spark, sf_dir):
    def show(pattern):
        return F.date_format("ts", pattern)

    return table(spark, sf_dir, "events", EVENTS_SCHEMA).select(
        "event_id",
        parse_ts(F.concat(show("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))).alias("precise"),
        parse_ts(show("yyyy-MM-dd HH:mm:ss")).alias("plain"),
        parse_ts(show("dd/MM/yyyy HH-mm-ss"), "%d/%m/%Y %H-%M-%S").alias("custom"),
        parse_ts(F.concat(show("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0130"))).alias("zoned"),
        parse_ts(F.concat(show("MMM "), F.lpad(show("d"), 2, " "), show(" HH:mm:ss")), "%b %e %H:%M:%S", F.lit(2024)).alias("bsd"),
        parse_ts(show("yyyy/MM/dd")).alias("bad"),
    )
