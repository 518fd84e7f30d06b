"""Predicates, filters, search, highlights, bookmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import search as se
from ..operators.categories import filter_category
from ..operators.predicates import cmp_num_or_text, field_text, log_cmp, predicate
from ..operators.region_lookup import filter_in_regions
from ..plans.scan import Scan, index_chunk, scan
from .common import DOC_LINES, doc_lines, logs, query, rendered, store, table, table_line, with_logs, with_store


def _ids(df):
    return df.select("id", "message")


def _cmp(name: str, field: str, op: str, value: str, sql: str):
    @query(name, with_logs(f"SELECT id, message FROM logs WHERE {sql}"))
    def run(spark, sf_dir):
        return _ids(logs(spark, sf_dir).filter(log_cmp(field, op, value)))


_cmp("f1_equal", "component", "==", "purchase", "component_name = 'purchase'")
_cmp("f2_not_equal", "level", "!=", "ERROR", "level <> 'ERROR'")
_cmp("f3_greater", "pid", ">", "75", "pid > 75")
_cmp("f4_greater_equal", "level", ">=", "INFO", "level >= 'INFO'")
_cmp("f5_less", "metadata.k", "<", "9", "CAST(k AS INT) < 9")
_cmp("f6_less_equal", "timestamp", "<=", "2024-01-10T00:00:00+00:00", "\"timestamp\" <= TIMESTAMP '2024-01-10'")
_cmp("f7_contains", "message", "contains", "value=1", "message LIKE '%value=1%'")
_cmp("f8_starts_with", "message", "starts_with", "click ", "starts_with(message, 'click ')")
_cmp("f9_ends_with", "message", "ends_with", "7", "suffix(message, '7')")
_cmp("f10_regex", "message", "regex", r"^(view|click) value=\d+\.5", r"regexp_matches(message, '^(view|click) value=\d+\.5')")


@query(
    "f11_logic",
    with_logs(
        """SELECT id, message FROM logs
        WHERE NOT coalesce(level = 'ERROR', false) AND (coalesce(context = 'u7', false) OR NOT coalesce(level <> 'INFO', false))"""
    ),
)
def f11(spark, sf_dir):
    cond = ~log_cmp("level", "==", "ERROR") & (log_cmp("context", "==", "u7") | ~log_cmp("level", "!=", "INFO"))
    return _ids(logs(spark, sf_dir).filter(cond))


@query(
    "f12_field",
    with_logs(
        """SELECT id, component_name AS component, k AS meta_k, CAST(NULL AS VARCHAR) AS absent,
           strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond("timestamp") % 1000000 = 0 THEN ''
             WHEN microsecond("timestamp") % 1000 = 0 THEN '.' || lpad(CAST(microsecond("timestamp") % 1000000 // 1000 AS VARCHAR), 3, '0')
             ELSE '.' || lpad(CAST(microsecond("timestamp") % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS ts_text,
           CAST(pid AS VARCHAR) AS pid FROM logs"""
    ),
)
def f12(spark, sf_dir):
    return logs(spark, sf_dir).select(
        "id",
        field_text("component").alias("component"),
        field_text("k").alias("meta_k"),
        field_text("no_such_field").alias("absent"),
        field_text("timestamp").alias("ts_text"),
        field_text("pid").alias("pid"),
    )


@query(
    "f13_number_or_text",
    """SELECT doc_id, seq, line, NOT (TRY_CAST(CASE WHEN regexp_matches(line, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN line END AS DOUBLE) IS NULL) AS is_number,
       CASE WHEN regexp_matches(line, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST(line AS DOUBLE) > 9.5 ELSE line > '9.5' END AS above
       FROM (SELECT *, 0 FROM (WITH """ + DOC_LINES + """ SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN CAST(length(line) AS VARCHAR) ELSE line END AS line FROM doc_lines))""",
)
def f13(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select(
        "doc_id",
        "seq",
        F.when(F.col("seq") % 3 == 0, F.length("line").cast("string")).otherwise(F.col("line")).alias("line"),
    )
    number = F.col("line").rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)\z")
    return lines.select(
        "doc_id", "seq", "line", number.alias("is_number"), cmp_num_or_text(F.col("line"), ">", "9.5").alias("above")
    )


@query(
    "f14_filter_set",
    with_logs(
        """SELECT id, message FROM logs WHERE NOT (message LIKE '%value=2%')
           AND (coalesce(level = 'ERROR', false) OR pid < 10)"""
    ),
)
def f14(spark, sf_dir):
    return _ids(
        fl.filter_set(
            logs(spark, sf_dir),
            include=["level = 'ERROR'", {"field": "pid", "op": "<", "value": "10"}],
            exclude=[{"field": "message", "op": "contains", "value": "value=2"}],
        )
    )


@query(
    "f15_filter_stack",
    with_logs(
        """SELECT id, message FROM logs WHERE coalesce(level <> 'DEBUG', false) AND pid > 20
           AND NOT (message LIKE '%value=3%') AND NOT coalesce(context = 'u33', false)"""
    ),
)
def f15(spark, sf_dir):
    entries = [
        ({"field": "level", "op": "!=", "value": "DEBUG"}, False),
        ({"field": "pid", "op": ">", "value": "20"}, False),
        ({"field": "message", "op": "contains", "value": "value=3"}, True),
        ({"field": "context", "op": "==", "value": "u33"}, True),
    ]
    return _ids(fl.filter_stack(logs(spark, sf_dir), entries))


@query("f16_min_level", with_logs("SELECT id, level FROM logs WHERE level_rank >= 3 OR level IS NULL"))
def f16(spark, sf_dir):
    return fl.min_level(logs(spark, sf_dir), "notice").select("id", "level")


@query("f17_level_preset", with_logs("SELECT id, level FROM logs WHERE level_rank >= 2"))
def f17(spark, sf_dir):
    return fl.level_preset(logs(spark, sf_dir), "INFO+").select("id", "level")


@query(
    "f18_quick_filter",
    with_logs("SELECT id, message FROM logs WHERE message LIKE '%value=4%' AND NOT message LIKE '%error%'"),
)
def f18(spark, sf_dir):
    return _ids(fl.quick_filter(fl.quick_filter(logs(spark, sf_dir), " value=4 "), "error", exclude=True))


@query(
    "f19_filter_like",
    with_logs(
        """SELECT l.id, l.message FROM logs l WHERE coalesce(l.context = 'u46', false) OR coalesce(l.hostname = 'host6', false)
           OR l.k = '89' OR l.component_name = 'click'"""
    ),
)
def f19(spark, sf_dir):
    record = {"context": "u46", "hostname": "host6", "component_name": "click", "metadata": {"k": "89"}}
    return _ids(fl.filter_like(logs(spark, sf_dir), record))


@query(
    "f20_time_range",
    with_logs(
        """SELECT id, "timestamp" FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-05 12:00:00'
           AND "timestamp" <= TIMESTAMP '2024-01-20 00:00:00'"""
    ),
)
def f20(spark, sf_dir):
    df = fl.time_range(logs(spark, sf_dir), after="2024-01-05T12:00:00Z", before="2024-01-20T00:00:00Z")
    return df.select("id", "timestamp")


@query(
    "f21_filter_set_spec",
    with_logs(
        """SELECT id, message FROM logs WHERE level_rank >= 2 AND pid % 2 = 0 AND NOT (message LIKE '%.9%')"""
    ),
)
def f21(spark, sf_dir):
    spec = {
        "filters": [
            {"expr": "pid % 2 = 0"},
            {"expr": "message LIKE '%.9%'", "exclude": True},
            {"expr": "this is not a predicate ((", "exclude": True},
        ],
        "level_filter": "INFO+",
    }
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _ids(fl.apply_filter_set(logs(spark, sf_dir), spec))


CATEGORY_RULES = [
    ("failures", {"field": "level", "op": "==", "value": "ERROR"}),
    ("even users", "pid % 2 = 0"),
    ("big", {"field": "message", "op": "regex", "value": r"value=\d{3,}"}),
    ("nothing", "false"),
    ("shop", {"any": [{"field": "component", "op": "==", "value": "purchase"}, "component_name = 'click'"]}),
]
CATEGORY_SQL = [
    ("failures", "coalesce(level = 'ERROR', false)"),
    ("even users", "pid % 2 = 0"),
    ("big", r"regexp_matches(message, 'value=\d{3,}')"),
    ("nothing", "false"),
    ("shop", "component_name IN ('purchase', 'click')"),
]


@query("f22_filter_category", with_logs("SELECT id, message FROM logs WHERE component_name IN ('purchase', 'click')"))
def f22(spark, sf_dir):
    return _ids(filter_category(logs(spark, sf_dir), CATEGORY_RULES, "shop"))


@query(
    "f23_filter_attr",
    """SELECT event_id, 'USER_TABLE' AS component_name FROM events WHERE event_type = 'purchase'""",
)
def f23(spark, sf_dir):
    from ..operators.chain import expand_attributes, parse_chain
    from ..operators.parsers import TABLE_PARSER

    rows = parse_chain(rendered(spark, sf_dir, table_line()), [TABLE_PARSER]).select("event_id", "parser", "parsed.*")
    return fl.filter_attr(expand_attributes(rows), "Attributes.type", "purchase").select("event_id", "component_name")


SIMPLE_REGIONS = """points AS (SELECT record_index, pid, component_name FROM store WHERE component_name IN ('view', 'purchase')),
  followed AS (SELECT *, lead(component_name) OVER w AS next_kind, lead(record_index) OVER w AS next_index
               FROM points WINDOW w AS (PARTITION BY pid ORDER BY record_index)),
  found AS (SELECT pid, record_index AS start_index, next_index AS end_index FROM followed
            WHERE component_name = 'view' AND next_kind = 'purchase')"""


def simple_regions(spark, sf_dir):
    """A view directly followed (per user) by a purchase."""
    pts = store(spark, sf_dir).filter(F.col("component_name").isin("view", "purchase"))
    named = F.concat(F.lit("user "), F.col("pid").cast("string"))
    following = F.struct("component_name", "record_index", "timestamp")
    return (
        scan(
            pts.select("pid", "component_name", "record_index", "timestamp", index_chunk().alias("chunk")),
            [Scan("nxt", following, "last", inclusive=False, backward=True)],
            by=["pid"],
            chunks=["chunk"],
            order=["record_index"],
        )
        .filter((F.col("component_name") == "view") & (F.col("nxt.component_name") == "purchase"))
        .select(
            F.lit("visit").alias("definition_name"),
            named.alias("name"),
            F.col("record_index").alias("start_index"),
            F.col("nxt.record_index").alias("end_index"),
            F.lit(False).alias("timed_out"),
            F.lit(0).alias("rule_ord"),
            F.col("nxt.record_index").alias("close_index"),
            F.col("timestamp").alias("start_ts"),
            F.col("nxt.timestamp").alias("end_ts"),
        )
    )


@query(
    "f24_in_regions",
    with_store(
        """SELECT s.id FROM store s WHERE EXISTS (SELECT 1 FROM found f WHERE s.record_index BETWEEN f.start_index AND f.end_index)""",
        SIMPLE_REGIONS,
    ),
)
def f24(spark, sf_dir):
    return filter_in_regions(store(spark, sf_dir), simple_regions(spark, sf_dir), type="visit").select("id")


@query(
    "f26_matches",
    with_logs("SELECT id, coalesce(level = 'ERROR', false) OR pid = 3 AS passes FROM logs"),
)
def f26(spark, sf_dir):
    cond = {"any": [{"field": "level", "op": "==", "value": "ERROR"}, {"field": "pid", "op": "==", "value": "3"}]}
    return fl.matches(logs(spark, sf_dir), cond, "passes").select("id", "passes")


@query(
    "q1_search",
    with_logs(r"SELECT id, message FROM logs WHERE regexp_matches(message, '(?i)ERROR VALUE=1') OR regexp_matches(raw, '(?i)\[\d*77\]')"),
)
def q1(spark, sf_dir):
    return _ids(se.search(logs(spark, sf_dir), r"ERROR VALUE=1|\[\d*77\]"))


@query(
    "q2_number_matches",
    with_store(
        """SELECT id, row_number() OVER (ORDER BY record_index) AS match_no, count(*) OVER () AS match_total
           FROM store WHERE regexp_matches(message, 'value=9')"""
    ),
)
def q2(spark, sf_dir):
    return se.number_matches(store(spark, sf_dir), "VALUE=9").select("id", "match_no", "match_total")


@query(
    "q3_next_prev_match",
    with_store(
        """SELECT id,
             coalesce(min(CASE WHEN m THEN record_index END) OVER (ORDER BY record_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                      min(CASE WHEN m THEN record_index END) OVER ()) AS next_match,
             coalesce(max(CASE WHEN m THEN record_index END) OVER (ORDER BY record_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      max(CASE WHEN m THEN record_index END) OVER ()) AS prev_match
           FROM (SELECT *, message LIKE '%value=7%' AS m FROM store)"""
    ),
)
def q3(spark, sf_dir):
    df = store(spark, sf_dir)
    return se.next_prev_match(df, F.col("message").contains("value=7")).select("id", "next_match", "prev_match")


HIGHLIGHTS = [("ones", "value=1"), ("errors", "^error"), ("cents", r"\.99")]


@query(
    "q4_tag_highlights",
    with_logs(
        r"""SELECT id, CASE WHEN regexp_matches(message, '\.99') THEN 'cents' WHEN regexp_matches(message, '^error') THEN 'errors'
           WHEN regexp_matches(message, 'value=1') THEN 'ones' END AS highlight FROM logs"""
    ),
)
def q4(spark, sf_dir):
    return se.tag_highlights(logs(spark, sf_dir), HIGHLIGHTS).select("id", "highlight")


@query(
    "q4_highlight_counts",
    "WITH " + DOC_LINES + """ SELECT 0 AS rule_ord, 'e words' AS "rule", count(*) FILTER (regexp_matches(line, 'en[a-z]+ la')) AS matches FROM doc_lines
       UNION ALL SELECT 1, 'digits', count(*) FILTER (regexp_matches(line, '[0-9]+')) FROM doc_lines
       UNION ALL SELECT 2, 'never', count(*) FILTER (regexp_matches(line, 'zzzzqq')) FROM doc_lines""",
)
def q4b(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).withColumnRenamed("line", "message")
    return se.highlight_counts(lines, [("e words", "en[a-z]+ la"), ("digits", "[0-9]+"), ("never", "zzzzqq")])


@query(
    "q5_bookmarked",
    with_store(
        """SELECT v.id, v.view_index FROM (SELECT id, row_number() OVER (ORDER BY record_index) - 1 AS view_index
             FROM store WHERE level IS NOT NULL) v
           WHERE v.id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')"""
    ),
)
def q5(spark, sf_dir):
    from .common import table

    view = store(spark, sf_dir).filter(F.col("level").isNotNull())
    ids = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return se.bookmarked(view, ids).select("id", "view_index")


@query(
    "e2_custom_filter",
    with_logs("SELECT id, message FROM logs WHERE length(message) % 2 = 0"),
)
def e2(spark, sf_dir):
    return _ids(logs(spark, sf_dir).filter(predicate(F.length("message") % 2 == 0)))


@query(
    "f10_regex_posix",
    r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[[:upper:]][[:lower:]]+,[[:space:]]+[[:alpha:]]+[[:punct:]]\n')",
)
def f10p(spark, sf_dir):
    """Named classes in a search over whole texts."""
    from ..functions.regex import search as regex_search

    docs = table(spark, sf_dir, "documents")
    return docs.filter(regex_search(F.col("text"), r"[[:upper:]][[:lower:]]+,[[:space:]]+[[:alpha:]]+[[:punct:]]\n")).select("doc_id")
