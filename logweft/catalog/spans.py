"""Regions: pairing, lookups, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import region_lookup as rl
from ..operators import regions as rg
from ..port_rules import port_rules
from ..rules import region_rules
from .common import events, level_of, query, store, with_store
from .filtering import SIMPLE_REGIONS, simple_regions

_USER = {"extract": [{"field": "pid", "regex": r"^(?P<user>\d+)$"}]}
VISIT_RULES = {
    "regions": [
        {
            "name": "visit",
            "start_points": [
                {"filter": "component_name = 'view'", "regex": r"view value=(?P<seen>\d+)", "reason": "saw {seen}", **_USER}
            ],
            "end_points": [
                {"filter": "component_name = 'purchase'", "regex": r"purchase value=(?P<paid>\d+)", "reason": "paid {paid}", **_USER}
            ],
            "correlate": ["user"],
            "template": {"name": "visit of {user}", "description": "{user}: {start_reason}, {end_reason}"},
            "timeout": "24h",
            "timeout_reason": "{user} left",
        },
    ]
}


def visit_rules():
    """View to purchase of the same user within a day."""
    return region_rules(VISIT_RULES)


_SPANS: dict = {}


def visit_spans(spark, sf_dir):
    from ..session import materialize

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SPANS:
        rules = visit_rules()
        _SPANS[key] = materialize(rg.pair_regions(rg.tag_points(store(spark, sf_dir), rules), rules), "visits")
    return _SPANS[key]


def visits(spark, sf_dir):
    return rg.render_regions(visit_spans(spark, sf_dir), visit_rules())


# An independent account of the pairing: each user's events are folded one by
# one over a list that serves as the stack of waiting starts.
STACK = """pts AS (SELECT pid, record_index AS i, epoch_us("timestamp") AS t, component_name AS kind,
    row_number() OVER (PARTITION BY pid ORDER BY record_index) AS n FROM store WHERE component_name IN ('view', 'purchase')),
  fold(pid, n, stack, start_i, end_i) AS (
    SELECT DISTINCT pid, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, t BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM pts
    UNION ALL
    SELECT p.pid, p.n,
      CASE WHEN p.kind = 'view' THEN list_append(f.stack, {'i': p.i, 't': p.t})
           WHEN len(f.stack) > 0 AND p.t - f.stack[-1].t < 86400000000 THEN f.stack[:-2] ELSE f.stack END,
      CASE WHEN p.kind = 'purchase' AND len(f.stack) > 0 AND p.t - f.stack[-1].t < 86400000000 THEN f.stack[-1].i END,
      CASE WHEN p.kind = 'purchase' AND len(f.stack) > 0 AND p.t - f.stack[-1].t < 86400000000 THEN p.i END
    FROM fold f JOIN pts p ON p.pid = f.pid AND p.n = f.n + 1),
  pairs AS (SELECT pid, start_i AS start_index, end_i AS end_index FROM fold WHERE end_i IS NOT NULL),
  last_view AS (SELECT max(t) AS t FROM pts WHERE kind = 'view'),
  waiting AS (SELECT p.pid, p.i, p.t FROM pts p LEFT JOIN pairs q ON q.start_index = p.i WHERE p.kind = 'view' AND q.start_index IS NULL),
  visits AS (SELECT pid, start_index, end_index, false AS timed_out FROM pairs
    UNION ALL SELECT w.pid, w.i, w.i, true FROM waiting w, last_view v WHERE v.t - w.t >= 86400000000)"""


@query(
    "g2_tag_points",
    with_store(
        r"""SELECT CAST(0 AS INT) AS rule_ord, CASE component_name WHEN 'view' THEN 1 ELSE 0 END AS kind, record_index AS idx, "timestamp" AS ts,
           CAST(pid AS VARCHAR) AS user, CASE WHEN component_name = 'view' THEN regexp_extract(message, '=(\d+)', 1) END AS seen,
           CASE WHEN component_name = 'purchase' THEN regexp_extract(message, '=(\d+)', 1) END AS paid
           FROM store WHERE component_name IN ('view', 'purchase')"""
    ),
)
def g2(spark, sf_dir):
    item = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return rg.tag_points(store(spark, sf_dir), visit_rules()).select(
        "rule_ord", "kind", "idx", "ts", item("user"), item("seen"), item("paid")
    )


@query("g3_pair_regions", with_store("SELECT start_index, end_index FROM pairs", STACK))
def g3(spark, sf_dir):
    return visit_spans(spark, sf_dir).filter("status = 'closed'").select("start_index", "end_index")


@query(
    "g4_timeouts",
    with_store(
        """SELECT w.i AS start_index, (SELECT min(p.i) FROM pts p WHERE p.kind = 'view' AND p.t >= w.t + 86400000000) AS close_index
           FROM waiting w, last_view v WHERE v.t - w.t >= 86400000000""",
        STACK,
    ),
)
def g4(spark, sf_dir):
    return visit_spans(spark, sf_dir).filter("status = 'timed_out'").select("start_index", "close_index")


@query(
    "g5_render_regions",
    with_store(
        r"""SELECT 'visit' AS definition_name, 'visit of ' || pid AS name, v.start_index, v.end_index, v.timed_out,
           pid || ': saw ' || regexp_extract(a.message, '=(\d+)', 1) || ', ' || CASE WHEN timed_out THEN pid || ' left' ELSE 'paid ' || regexp_extract(b.message, '=(\d+)', 1) END AS description,
           'saw ' || regexp_extract(a.message, '=(\d+)', 1) AS start_reason,
           CASE WHEN timed_out THEN pid || ' left' ELSE 'paid ' || regexp_extract(b.message, '=(\d+)', 1) END AS end_reason,
           a."timestamp" AS start_ts, b."timestamp" AS end_ts
           FROM (SELECT pid AS p_id, * FROM visits) v JOIN (SELECT record_index, message, "timestamp" FROM store) a ON a.record_index = v.start_index
           JOIN (SELECT record_index, message, "timestamp" FROM store) b ON b.record_index = v.end_index""",
        STACK,
    ),
)
def g5(spark, sf_dir):
    return visits(spark, sf_dir).select(
        "definition_name", "name", "start_index", "end_index", "timed_out", "description", "start_reason", "end_reason",
        "start_ts", "end_ts",
    )


@query(
    "g6_open_regions",
    with_store("SELECT w.i AS start_index FROM waiting w, last_view v WHERE v.t - w.t < 86400000000", STACK),
)
def g6(spark, sf_dir):
    return rg.open_regions(visit_spans(spark, sf_dir)).select("start_index")


@query("g7_order_by_start", with_store("SELECT start_index, end_index, timed_out FROM visits", STACK))
def g7(spark, sf_dir):
    return rg.order_by_start(visits(spark, sf_dir)).select("start_index", "end_index", "timed_out")


@query(
    "g8_regions_at",
    with_store(
        """SELECT s.id, f.start_index, f.end_index FROM store s JOIN found f
           ON s.record_index BETWEEN f.start_index AND f.end_index""",
        SIMPLE_REGIONS,
    ),
)
def g8(spark, sf_dir):
    logs = store(spark, sf_dir).select("id", "record_index")
    return rl.regions_at(logs, simple_regions(spark, sf_dir)).select("id", "region.start_index", "region.end_index")


_INNERMOST = """inner_most AS (SELECT s.id, s.record_index, arg_min(f, (f.end_index - f.start_index, f.start_index)) AS best
  FROM store s LEFT JOIN found f ON s.record_index BETWEEN f.start_index AND f.end_index GROUP BY s.id, s.record_index)"""


@query(
    "g9_innermost_region",
    with_store("SELECT id, best.start_index AS start_index, best.end_index AS end_index FROM inner_most", SIMPLE_REGIONS, _INNERMOST),
)
def g9(spark, sf_dir):
    return rl.innermost_region(store(spark, sf_dir), simple_regions(spark, sf_dir)).select(
        "id", "region.start_index", "region.end_index"
    )


@query(
    "g10_mark_regions",
    with_store(
        """SELECT id, CASE WHEN best.start_index IS NULL THEN 'none' WHEN record_index = best.start_index THEN 'start'
           WHEN record_index = best.end_index THEN 'end' ELSE 'inside' END AS marker FROM inner_most""",
        SIMPLE_REGIONS,
        _INNERMOST,
    ),
)
def g10(spark, sf_dir):
    return rl.mark_regions(store(spark, sf_dir), simple_regions(spark, sf_dir)).select("id", "marker")


@query(
    "g11_region_list",
    with_store(
        """SELECT start_index, end_index, epoch_us(b."timestamp") // 1000 - epoch_us(a."timestamp") // 1000 AS duration_ms
           FROM visits v JOIN store a ON a.record_index = start_index JOIN store b ON b.record_index = end_index""",
        STACK,
    ),
)
def g11(spark, sf_dir):
    return rl.region_list(visits(spark, sf_dir), "visit", sort="duration").select("start_index", "end_index", "duration_ms")


@query(
    "g12_region_timeline",
    with_store(
        """SELECT definition_name, bin, timed_out FROM (WITH r AS (SELECT v.*, epoch_us(a."timestamp") // 1000 AS s, epoch_us(b."timestamp") // 1000 AS e
             FROM visits v JOIN store a ON a.record_index = start_index JOIN store b ON b.record_index = end_index),
           g AS (SELECT min(s) AS lo, max(e) AS hi FROM r),
           c AS (SELECT r.*, least(CAST(floor((s - lo) / greatest(hi - lo, 1)::DOUBLE * 60.0::DOUBLE) AS BIGINT), 59) AS a,
                    least(CAST(floor((e - lo) / greatest(hi - lo, 1)::DOUBLE * 60.0::DOUBLE) AS BIGINT), 60) AS z FROM r, g)
           SELECT 'visit' AS definition_name, bin, arg_max(timed_out, (s, e, start_index)) AS timed_out
           FROM (SELECT *, unnest(range(a, greatest(z, a + 1))) AS bin FROM c) GROUP BY bin)""",
        STACK,
    ),
)
def g12(spark, sf_dir):
    return rl.region_timeline(visits(spark, sf_dir), 60)


@query(
    "g13_next_region",
    with_store(
        """SELECT s.id, f.start_index AS next_start FROM store s ASOF LEFT JOIN (SELECT DISTINCT start_index FROM found) f
           ON s.record_index < f.start_index""",
        SIMPLE_REGIONS,
    ),
)
def g13(spark, sf_dir):
    return rl.next_region(store(spark, sf_dir), simple_regions(spark, sf_dir)).select("id", "next_start")


@query("g15_regions_by_type", with_store("SELECT start_index, end_index FROM visits", STACK))
def g15(spark, sf_dir):
    return rl.regions_by_type(visits(spark, sf_dir), "visit").select("start_index", "end_index")


@query(
    "g15_regions_in_range",
    with_store("SELECT start_index, end_index FROM visits WHERE start_index <= 4000 AND end_index >= 3000", STACK),
)
def g15b(spark, sf_dir):
    return rl.regions_in_range(visits(spark, sf_dir), 3000, 4000).select("start_index", "end_index")


@query(
    "a17_region_summary",
    with_store(
        """SELECT definition_name, is_total, regions, completed, timed_out FROM (
             SELECT 'visit' AS definition_name, false AS is_total, count(*) AS regions, count(*) FILTER (NOT timed_out) AS completed, count(*) FILTER (timed_out) AS timed_out FROM visits
             UNION ALL SELECT NULL, true, count(*), count(*) FILTER (NOT timed_out), count(*) FILTER (timed_out) FROM visits)""",
        STACK,
    ),
)
def a17(spark, sf_dir):
    return rl.region_summary(visits(spark, sf_dir))


def _queue_rules(**more):
    """First in, first out, with the richer points: include all, exclude any."""
    return region_rules(
        {
            "regions": [
                {
                    "name": "queue",
                    "pairing": "oldest",
                    **more,
                    "start_points": [
                        {"include": ["component_name = 'view'"], "exclude": ["pid < 20", {"field": "message", "op": "contains", "value": "value=9"}],
                         "extract": [{"field": "pid", "regex": r"(?P<user>\d+)"}]}
                    ],
                    "end_points": [
                        {"include": ["component_name = 'purchase'", "pid >= 20"], "extract": [{"field": "pid", "regex": r"(?P<user>\d+)"}]}
                    ],
                    "correlate": ["user"],
                    "template": {"name": "{user}"},
                }
            ]
        }
    )


@query(
    "g16_oldest_first",
    with_store(
        """SELECT start_i AS start_index, end_i AS end_index FROM fold WHERE end_i IS NOT NULL""",
        """pts AS (SELECT pid, record_index AS i, component_name AS kind, row_number() OVER (PARTITION BY pid ORDER BY record_index) AS n FROM store
             WHERE pid >= 20 AND (component_name = 'purchase' OR (component_name = 'view' AND message NOT LIKE '%value=9%')))""",
        """fold(pid, n, q, start_i, end_i) AS (
             SELECT DISTINCT pid, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM pts
             UNION ALL SELECT p.pid, p.n, CASE WHEN p.kind = 'view' THEN list_append(f.q, p.i) ELSE f.q[2:] END,
               CASE WHEN p.kind = 'purchase' AND len(f.q) > 0 THEN f.q[1] END, CASE WHEN p.kind = 'purchase' AND len(f.q) > 0 THEN p.i END
             FROM fold f JOIN pts p ON p.pid = f.pid AND p.n = f.n + 1)""",
    ),
)
def g16(spark, sf_dir):
    rules = _queue_rules()
    spans = rg.pair_regions(rg.tag_points(store(spark, sf_dir), rules), rules)
    return spans.filter("status = 'closed'").select("start_index", "end_index")


@query(
    "g16_oldest_first_timeout",
    with_store(
        """SELECT start_i AS start_index, end_i AS end_index FROM fold WHERE end_i IS NOT NULL""",
        """pts AS (SELECT pid, record_index AS i, epoch_us("timestamp") AS t, component_name AS kind, row_number() OVER (PARTITION BY pid ORDER BY record_index) AS n FROM store
             WHERE pid >= 20 AND (component_name = 'purchase' OR (component_name = 'view' AND message NOT LIKE '%value=9%')))""",
        """fold(pid, n, q, start_i, end_i) AS (
             SELECT DISTINCT pid, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, t BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM pts
             UNION ALL SELECT pid, n, CASE WHEN kind = 'view' THEN list_append(fresh, {'i': i, 't': t}) ELSE fresh[2:] END,
               CASE WHEN kind = 'purchase' AND len(fresh) > 0 THEN fresh[1].i END, CASE WHEN kind = 'purchase' AND len(fresh) > 0 THEN i END
             FROM (SELECT p.pid, p.n, p.kind, p.i, p.t, list_filter(f.q, lambda x: p.t - x.t < 432000000000) AS fresh
                   FROM fold f JOIN pts p ON p.pid = f.pid AND p.n = f.n + 1))""",
    ),
)
def g16b(spark, sf_dir):
    rules = _queue_rules(timeout="120h")
    spans = rg.pair_regions(rg.tag_points(store(spark, sf_dir), rules), rules)
    return spans.filter("status = 'closed'").select("start_index", "end_index")


def port_logs(spark, sf_dir):
    """Events told as port messages: the user is the port, the type says what happened."""
    from ..operators.ordering import with_record_index
    from ..sources.tables import as_logs

    # Forty ports, so that something happens to a port within seconds.
    port = F.concat(F.lit("Ethernet"), (F.col("user_id") % 40).cast("string"))
    kind = F.col("event_type")
    text = (
        F.when((kind == "signup") & (F.col("event_id") % 50 == 0), F.lit("PortConfigDone"))
        .when((kind == "click") & (F.col("event_id") % 50 == 1), F.lit("PortInitDone"))
        .when(kind == "signup", F.concat(F.lit("Initialized port "), port))
        .when(kind == "purchase", F.concat(F.lit("Set admin status UP host_tx_ready to true for port "), port))
        .when(kind == "click", F.concat(F.lit("Set port "), port, F.lit(" FEC mode rs")))
        .when(
            (kind == "error") & (F.col("event_id") % 3 == 0),
            F.concat(F.lit("Set admin status DOWN host_tx_ready to false for port "), port),
        )
        .when(kind == "error", F.concat(F.lit("Port "), port, F.lit(" oper state set from up to down")))
        .otherwise(F.concat(F.lit("Port "), port, F.lit(" oper state set from down to up")))
    )
    df = events(spark, sf_dir)
    # An event every second instead of every few minutes, so that the rules' timeouts mean something.
    ts = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("event_id") * 1_000_000)
    return with_record_index(
        as_logs(df, {"id": "event_id", "timestamp": ts, "level": level_of(kind), "source": F.lit("ports"), "message": text})
    )


@query(
    "g17_port_lifecycle",
    """WITH RECURSIVE m AS (SELECT event_id AS i, user_id % 40 AS port, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'down' ELSE event_type END AS k, CAST(event_id AS BIGINT) AS t,
         event_type = 'signup' AND event_id % 50 = 0 AS cfg, event_type = 'click' AND event_id % 50 = 1 AS ini FROM events),
       s(rule, tmo, port, i, t, d) AS (
         SELECT 'sonic_port_boot_init', 120, port, i, t, 1 FROM m WHERE k = 'signup' AND NOT cfg
         UNION ALL SELECT 'sonic_port_boot_init', 120, port, i, t, -1 FROM m WHERE k IN ('error', 'view')
         UNION ALL SELECT 'sonic_port_admin_up', 60, port, i, t, 1 FROM m WHERE k = 'purchase'
         UNION ALL SELECT 'sonic_port_admin_up', 60, port, i, t, -1 FROM m WHERE k = 'view'
         UNION ALL SELECT 'sonic_port_admin_down', 10, port, i, t, 1 FROM m WHERE k = 'down'
         UNION ALL SELECT 'sonic_port_admin_down', 10, port, i, t, -1 FROM m WHERE k = 'error'
         UNION ALL SELECT 'sonic_port_link_flap', 300, port, i, t, 1 FROM m WHERE k = 'error'
         UNION ALL SELECT 'sonic_port_link_flap', 300, port, i, t, -1 FROM m WHERE k = 'view'
         UNION ALL SELECT 'sonic_system_port_init', 300, NULL, i, t, 1 FROM m WHERE cfg
         UNION ALL SELECT 'sonic_system_port_init', 300, NULL, i, t, -1 FROM m WHERE ini
         UNION ALL SELECT 'sonic_port_attr_change', 60, port, i, t, 1 FROM m WHERE k = 'click' AND NOT ini
         UNION ALL SELECT 'sonic_port_attr_change', 60, port, i, t, -1 FROM m WHERE k = 'view'),
       p AS (SELECT *, row_number() OVER (PARTITION BY rule, port ORDER BY i) AS n FROM s),
       fold(rule, tmo, port, n, stack, st, en, si) AS (
         SELECT DISTINCT rule, tmo, port, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, t BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM p
         UNION ALL SELECT p.rule, p.tmo, p.port, p.n,
           CASE WHEN d = 1 THEN list_append(stack, {'i': p.i, 't': p.t}) WHEN len(stack) > 0 AND p.t - stack[-1].t < p.tmo THEN stack[:-2] ELSE stack END,
           CASE WHEN d = -1 AND len(stack) > 0 AND p.t - stack[-1].t < p.tmo THEN stack[-1].t END,
           CASE WHEN d = -1 AND len(stack) > 0 AND p.t - stack[-1].t < p.tmo THEN p.t END,
           CASE WHEN d = -1 AND len(stack) > 0 AND p.t - stack[-1].t < p.tmo THEN stack[-1].i END
         FROM fold f JOIN p ON p.rule = f.rule AND p.port IS NOT DISTINCT FROM f.port AND p.n = f.n + 1),
       done AS (SELECT rule, port, st, en, si FROM fold WHERE en IS NOT NULL),
       gone AS (SELECT p.rule, p.port, p.t FROM p LEFT JOIN done ON done.rule = p.rule AND done.si = p.i
                WHERE d = 1 AND done.si IS NULL AND (SELECT max(q.t) FROM s q WHERE q.rule = p.rule AND q.d = 1) - p.t >= p.tmo)
       SELECT definition_name, port, CAST(sum(c) AS BIGINT) AS completed, CAST(sum(x) AS BIGINT) AS timed_out, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(max(ms) AS BIGINT) AS max_ms FROM (
         SELECT rule AS definition_name, 'Ethernet' || port AS port, 1 AS c, 0 AS x, (en - st) * 1000 AS ms FROM done
         UNION ALL SELECT rule, 'Ethernet' || port, 0, 1, NULL FROM gone) GROUP BY 1, 2""",
)
def g17(spark, sf_dir):
    return rg.port_lifecycle(port_logs(spark, sf_dir), port_rules())
