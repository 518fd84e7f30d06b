"""Regions: spans from a start record to the end record it belongs to.

An end takes the newest start that is still waiting and has the same correlate
values: bracket matching per (rule, key). It is done with ordered scans whose
tasks are bounded by chunks of positions, so a key that owns most of the events
does not end up in one task.

Needs ``logs`` with ``record_index`` (``ordering.with_record_index``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.regex import translate
from ..functions.text import render
from ..plans.asof import nearest_in_time
from ..plans.scan import CHUNK_BITS, Scan, scan
from ..rules import MatchPoint, RegionRule
from ..session import materialize, shuffled
from .predicates import field_text, predicate

END, START = 0, 1

_EMPTY = "CAST(map() AS MAP<STRING, STRING>)"


def _extracted(point: MatchPoint) -> Column:
    """Named groups of the point's regexes, as a map."""
    entries = []
    for name, pattern in point.extract:
        p, text = translate(pattern), field_text(name)
        hit = F.coalesce(text.rlike(p.java), F.lit(False))
        for group, number in zip(p.names, p.numbers):
            value = F.regexp_extract(text, p.java, number)
            found = hit & (value != "") if group in p.optional else hit
            entries.append(F.when(found, F.struct(F.lit(group).alias("k"), value.alias("v"))))
    if not entries:
        return F.expr(_EMPTY)
    # The first extraction of a name counts.
    seen = F.array_compact(F.array(*entries))
    names = {g for _, pat in point.extract for g in translate(pat).names}
    if len(names) == len(entries):
        return F.map_from_entries(seen)
    unique = F.filter(seen, lambda e, i: ~F.exists(F.slice(seen, F.lit(1), i), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(unique)


def _first_point(points: tuple[MatchPoint, ...], rule_ord: int, kind: int) -> Column:
    def item(i: int, p: MatchPoint) -> Column:
        return F.when(
            predicate(p.where),
            F.struct(
                F.lit(rule_ord).alias("rule_ord"),
                F.lit(kind).alias("kind"),
                F.lit(i).alias("point"),
                _extracted(p).alias("metadata"),
            ),
        )

    return F.coalesce(*[item(i, p) for i, p in enumerate(points)])


def point_items(rules: list[RegionRule]) -> Column:
    """The start and end events of all rules that a record is, as an array."""
    items = []
    for r, rule in enumerate(rules):
        items += [_first_point(rule.end_points, r, END), _first_point(rule.start_points, r, START)]
    return F.array_compact(F.array(*items))


def tag_points(logs: DataFrame, rules: list[RegionRule]) -> DataFrame:
    """Start and end events of all rules, found in one scan.

    Columns ``rule_ord, kind (0 end, 1 start), point, idx, ts, metadata``; the
    first point whose predicate holds counts, even if its regex does not match.
    """
    return listed_points(logs, point_items(rules))


def listed_points(logs: DataFrame, items: Column) -> DataFrame:
    """Points from ``items``, an array like that of ``point_items``."""
    return (
        logs.select(F.col("record_index").alias("idx"), F.col("timestamp").alias("ts"), F.explode(items).alias("e"))
        .select("e.rule_ord", "e.kind", "e.point", "idx", "ts", "e.metadata")
    )


def _by_rule(rules: list[RegionRule], value: Callable[[RegionRule], Column | None], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for r, rule in enumerate(rules):
        v = value(rule)
        if v is not None:
            out = F.when(F.col("rule_ord") == r, v).otherwise(out)
    return out


def _correlate_key(rules: list[RegionRule]) -> Column:
    def key(rule: RegionRule) -> Column:
        if not rule.correlate:
            return F.expr("CAST(array() AS ARRAY<STRING>)")
        return F.array(*[F.try_element_at(F.col("metadata"), F.lit(c)) for c in rule.correlate])

    return _by_rule(rules, key, "array<string>")


_KEY = ["rule_ord", "key"]


def _nesting(events: DataFrame) -> DataFrame:
    """Add ``level`` (nesting depth of the bracket) and drop ends that close nothing."""
    keys = _KEY + ["chunk"]
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    depth = F.when(F.col("kind") == START, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    local = (
        events.withColumn("_d", depth)
        .withColumn("_s", F.sum("_d").over(w))
        .withColumn("_low", F.min("_s").over(w))
        .withColumn("_low_before", F.min("_s").over(before))
    )
    totals = local.groupBy(*keys).agg(F.sum("_d").alias("_t"), F.min("_s").alias("_m"))
    past = W.partitionBy(*_KEY).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        totals.withColumn("_off", F.coalesce(F.sum("_t").over(past), F.lit(0)))
        .withColumn("_floor", F.min(F.col("_off") + F.col("_m")).over(past))
        .select(*keys, "_off", "_floor")
    )
    zero = F.lit(0).cast("bigint")
    running = F.col("_off") + F.col("_s")
    low = F.least(zero, F.col("_floor"), F.col("_off") + F.col("_low"))
    low_before = F.least(zero, F.col("_floor"), F.col("_off") + F.col("_low_before"))
    is_start = F.col("kind") == START
    return (
        local.join(carried, keys)
        .filter(is_start | (running >= low_before))
        .withColumn("level", running - low + F.when(is_start, F.lit(0)).otherwise(F.lit(1)))
        .select(*events.columns, "level")
    )


_CLAMP = "rule_ord int, key array<string>, chunk bigint, lo bigint, hi bigint"


_CARRY = "rule_ord int, key array<string>, chunk bigint, d bigint"
_RANKS = "rule_ord int, key array<string>, pos bigint, _rank bigint"
_LEAST, _MOST = -(1 << 62), 1 << 62


def _composed(rows):
    """One row a group: its steps as one step, which lifts a value to ``lo`` and then cuts it to ``hi``."""
    last, low, high = None, _LEAST, _MOST
    for rule, key, chunk, lo, hi in rows("rule_ord", "key", "chunk", "lo", "hi"):
        if last is not None and last != (rule, key, chunk):
            yield *last, low, high
            low, high = _LEAST, _MOST
        last = (rule, key, chunk)
        low, high = min(max(low, lo), hi), min(max(high, lo), hi)
    if last is not None:
        yield *last, low, high


def _carried(rows):
    """Every chunk with the value before it."""
    last = None
    for rule, key, chunk, lo, hi in rows("rule_ord", "key", "chunk", "lo", "hi"):
        if last != (rule, key):
            last, d = (rule, key), 0
        yield rule, key, chunk, d
        d = min(max(d, lo), hi)


def _taken(rows):
    """Every end with the number of the start that it takes, or none."""
    last = None
    for rule, key, chunk, pos, lo, hi, f, b, j, carry in rows("rule_ord", "key", "chunk", "pos", "lo", "hi", "_f", "_b", "_j", "d"):
        if last != (rule, key, chunk):
            last, d = (rule, key, chunk), carry
        used = max(d + j - 1, f)
        yield rule, key, pos, used + 1 if used < b else None
        d = min(max(d, lo), hi)


# Rows of a batch that goes back to Spark.
_BATCH = 10_000


def _in_groups(df: DataFrame, by: list[str], order: str, step: Callable, schema: str) -> DataFrame:
    """Go through the rows of every group in ``order``, group after group in one pass over a partition.

    ``step`` gets a function that yields the named columns row by row, and yields rows of ``schema``. No group
    is held, and the many small groups of a table cost no call each.
    """
    kinds = StructType.fromDDL(schema)

    def run(batches):
        def rows(*columns):
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in columns])

        out = step(rows)
        arrow = to_arrow_schema(kinds)
        while part := list(islice(out, _BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, kinds)


def _oldest_in_time(events: DataFrame, timeout_us: Column, event: Column) -> DataFrame:
    """First in, first out among the starts that have not expired: every start with its end.

    Let f be the number of starts expired at an end, b of those before it, c of those used or skipped
    so far: the end takes start max(c, f) + 1 if that is at most b. In d = c less the ends so far
    each end lifts d to a low and cuts it to a high, and such steps compose to one of the same
    kind. So chunks are worked out by themselves, their composites (one row each) are run through per key,
    and the chunks are gone through again from the right d, row by row.
    """
    one = lambda k: F.when(F.col("kind") == k, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    ranked = materialize(
        scan(events, [Scan("_b", one(START), "sum"), Scan("_j", one(END), "sum")], by=_KEY, chunks=["chunk"], order=["pos"]),
        "region-queue",
    )
    starts = ranked.filter(F.col("kind") == START)
    # The instant up to which starts are too old, exclusive.
    fresh = F.timestamp_micros(F.unix_micros("ts") - timeout_us + 1)
    ends = ranked.filter(F.col("kind") == END).withColumn("_fresh", fresh)
    old = nearest_in_time(ends, starts, by=_KEY, probe_ts="_fresh", mark_ts="ts", mark_index="_b").select(
        *_KEY, "_fresh", F.coalesce("prev_index", F.lit(0)).alias("_f")
    )
    steps = materialize(
        ends.join(old, [*_KEY, "_fresh"]).select(
            *_KEY, "chunk", "pos", "_f", "_b", "_j", (F.col("_f") - F.col("_j") + 1).alias("lo"), (F.col("_b") - F.col("_j")).alias("hi")
        ),
        "region-steps",
    )

    carry = materialize(_in_groups(_in_groups(steps, [*_KEY, "chunk"], "pos", _composed, _CLAMP), _KEY, "chunk", _carried, _CARRY), "region-carry")
    matched = _in_groups(steps.join(shuffled(carry), [*_KEY, "chunk"]), [*_KEY, "chunk"], "pos", _taken, _RANKS)
    found = ends.join(matched.filter("_rank IS NOT NULL"), [*_KEY, "pos"]).select(*_KEY, F.col("_rank").alias("_b"), event.alias("end"))
    return starts.join(found, [*_KEY, "_b"], "left").select("rule_ord", "idx", "ts", "point", "metadata", "end")


def pair_regions(points: DataFrame, rules: list[RegionRule]) -> DataFrame:
    """Pair starts with ends: one row per start with ``status``.

    ``closed`` (with its end), ``timed_out`` (a later start of the rule came at
    least the timeout after it) or ``open``. ``close_index`` is the record that
    closed or expired it.
    """
    # Scanned several times below and far smaller than the logs.
    points = materialize(points, "region-points")
    pos = F.col("idx") * 2 + F.col("kind")
    events = (
        points.withColumn("key", _correlate_key(rules))
        .withColumn("pos", pos)
        .withColumn("chunk", F.shiftright(pos, CHUNK_BITS))
    )
    has_key = F.forall("key", lambda k: k.isNotNull())
    nested = _nesting(events.filter(has_key))
    newest = [i for i, r in enumerate(rules) if not r.oldest_first]
    oldest = [i for i, r in enumerate(rules) if r.oldest_first and not r.timeout]
    fading = [i for i, r in enumerate(rules) if r.oldest_first and r.timeout]
    timeout_us = _by_rule(rules, lambda r: F.lit(r.timeout * 1_000_000) if r.timeout else None, "bigint")
    event = F.struct("kind", "idx", "ts", "point", "metadata")
    parts = []
    if newest:
        # In a (rule, key, level) starts and ends alternate: a start's end is the next row.
        paired = scan(
            nested.filter(F.col("rule_ord").isin(*newest)),
            [Scan("_next", event, "last", inclusive=False, backward=True)],
            by=_KEY + ["level"],
            chunks=["chunk"],
            order=["pos"],
        ).filter(F.col("kind") == START)
        follows = F.when(F.col("_next.kind") == END, F.col("_next"))
        parts.append(paired.select("rule_ord", "idx", "ts", "point", "metadata", follows.alias("end")))
    if oldest:
        # First in, first out: the k-th start belongs to the k-th end that finds any.
        one = lambda k: F.when(F.col("kind") == k, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        ranked = scan(
            nested.filter(F.col("rule_ord").isin(*oldest)),
            [Scan("_ns", one(START), "sum"), Scan("_ne", one(END), "sum")],
            by=_KEY,
            chunks=["chunk"],
            order=["pos"],
        )
        starts = ranked.filter(F.col("kind") == START).withColumn("_k", F.col("_ns"))
        ends = ranked.filter(F.col("kind") == END).select(
            "rule_ord", "key", F.col("_ne").alias("_k"), event.alias("end")
        )
        parts.append(
            starts.join(ends, ["rule_ord", "key", "_k"], "left").select(
                "rule_ord", "idx", "ts", "point", "metadata", "end"
            )
        )
    if fading:
        parts.append(_oldest_in_time(events.filter(has_key & F.col("rule_ord").isin(*fading)), timeout_us, event))
    loose = events.filter(~has_key & (F.col("kind") == START)).select(
        "rule_ord", "idx", "ts", "point", "metadata"
    )
    out = reduce(DataFrame.unionByName, parts).unionByName(loose, allowMissingColumns=True)
    elapsed = F.unix_micros("end.ts") - F.unix_micros("ts")
    in_time = F.col("end").isNotNull() & (timeout_us.isNull() | (elapsed < timeout_us))
    starts = out.withColumn("end", F.when(in_time, F.col("end"))).withColumn(
        "expires", F.when(F.col("end").isNull(), F.timestamp_micros(F.unix_micros("ts") + timeout_us))
    )
    if not any(r.timeout for r in rules):
        expired = starts.withColumn("expired_by", F.lit(None).cast("bigint"))
    else:
        starts = materialize(starts, "region-starts")
        late = nearest_in_time(
            starts.filter(F.col("expires").isNotNull()),
            points.filter(F.col("kind") == START),
            by=["rule_ord"],
            probe_ts="expires",
            mark_ts="ts",
            mark_index="idx",
        ).select("rule_ord", "expires", F.col("next_index").alias("expired_by"))
        expired = starts.join(late, ["rule_ord", "expires"], "left")
    closed = F.col("end").isNotNull()
    return expired.select(
        "rule_ord",
        F.col("idx").alias("start_index"),
        F.col("ts").alias("start_ts"),
        F.col("point").alias("start_point"),
        F.col("metadata").alias("start_metadata"),
        F.when(closed, F.col("end.idx")).otherwise(F.col("idx")).alias("end_index"),
        F.when(closed, F.col("end.ts")).otherwise(F.col("ts")).alias("end_ts"),
        F.col("end.point").alias("end_point"),
        F.col("end.metadata").alias("end_metadata"),
        F.coalesce("end.idx", "expired_by").alias("close_index"),
        F.when(closed, "closed").when(F.col("expired_by").isNotNull(), "timed_out").otherwise("open").alias("status"),
    )


def open_regions(spans: DataFrame) -> DataFrame:
    """Starts still waiting for their end."""
    return spans.filter(F.col("status") == "open").select(
        "rule_ord", "start_index", "start_ts", "start_point", "start_metadata"
    )


def _merged(first: Column, second: Column) -> Column:
    """Map union, the second winning."""
    return F.map_zip_with(first, second, lambda k, a, b: F.coalesce(b, a))


def _with(values: Column, key: str, text: Column) -> Column:
    extra = F.create_map(F.lit(key), text)
    return F.when(text.isNotNull(), _merged(values, extra)).otherwise(values)


def _point_reason(rules: list[RegionRule], side: str, point: str, values: Column) -> Column:
    def pick(rule: RegionRule) -> Column | None:
        out = None
        for i, p in enumerate(rule.start_points if side == "start" else rule.end_points):
            if p.reason is not None:
                hit = F.col(point) == i
                text = render(p.reason, values)
                out = F.when(hit, text) if out is None else out.when(hit, text)
        return out

    return _by_rule(rules, pick, "string")


def render_regions(spans: DataFrame, rules: list[RegionRule]) -> DataFrame:
    """Finished spans as ``regions``: merged metadata, reasons, name and description filled in."""
    done = spans.filter(F.col("status") != "open")
    timed_out = F.col("status") == "timed_out"
    base = done.withColumn("timed_out", timed_out).withColumn(
        "_base",
        F.when(F.col("timed_out"), F.col("start_metadata")).otherwise(
            _merged(F.col("start_metadata"), F.coalesce("end_metadata", F.expr(_EMPTY)))
        ),
    )
    start_reason = _point_reason(rules, "start", "start_point", F.col("start_metadata"))
    end_reason = F.when(
        F.col("timed_out"),
        _by_rule(
            rules, lambda r: render(r.timeout_reason, F.col("_base")) if r.timeout_reason else None, "string"
        ),
    ).otherwise(_point_reason(rules, "end", "end_point", F.col("_base")))
    reasons = base.withColumn("start_reason", start_reason).withColumn("end_reason", end_reason)
    full = reasons.withColumn(
        "metadata",
        _with(_with(F.col("_base"), "start_reason", F.col("start_reason")), "end_reason", F.col("end_reason")),
    )
    meta = F.col("metadata")
    return full.select(
        _by_rule(rules, lambda r: F.lit(r.name), "string").alias("definition_name"),
        _by_rule(rules, lambda r: render(r.name_template, meta), "string").alias("name"),
        _by_rule(
            rules,
            lambda r: render(r.description_template, meta) if r.description_template is not None else None,
            "string",
        ).alias("description"),
        "start_reason",
        "end_reason",
        "start_index",
        "end_index",
        "metadata",
        "timed_out",
        "rule_ord",
        "close_index",
        "start_ts",
        "end_ts",
    )


def regions(logs: DataFrame, rules: list[RegionRule]) -> DataFrame:
    """All finished regions of the logs (unordered)."""
    return render_regions(pair_regions(tag_points(logs, rules), rules), rules)


START_ORDER = ("start_index", "close_index", "rule_ord")


def order_by_start(found: DataFrame) -> DataFrame:
    return found.orderBy(*START_ORDER)


def port_lifecycle(logs: DataFrame, rules: list[RegionRule]) -> DataFrame:
    """Per rule and port: completed and timed-out regions, total and longest duration."""
    found = regions(logs, rules)
    ms = F.when(~F.col("timed_out"), F.unix_millis("end_ts") - F.unix_millis("start_ts"))
    port = F.try_element_at(F.col("metadata"), F.lit("port")).alias("port")
    return found.groupBy("definition_name", port).agg(
        F.count_if(~F.col("timed_out")).alias("completed"),
        F.count_if("timed_out").alias("timed_out"),
        F.sum(ms).alias("total_ms"),
        F.max(ms).alias("max_ms"),
    )
