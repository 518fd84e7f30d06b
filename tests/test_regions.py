"""Regions against a plain model of the rules, on random events."""

import random

import pytest
from pyspark.sql import functions as F

from logweft.operators import region_lookup as rl
from logweft.operators.regions import open_regions, pair_regions, regions, tag_points
from logweft.rules import region_rules

BASE = 1_700_000_000


def logs_of(spark, rows):
    """rows: (seconds, message)."""
    data = [(i, t, m) for i, (t, m) in enumerate(rows)]
    df = spark.createDataFrame(data, "record_index bigint, t bigint, message string")
    return df.select(
        "record_index",
        F.timestamp_seconds(F.col("t") + BASE).alias("timestamp"),
        "message",
    )


def rule(name="r", correlate=("p",), timeout=None, timeout_reason=None, start="start", end="end"):
    return {
        "name": name,
        "start_points": [{"filter": f"message like '%{start}%'", "regex": r"p=(?P<p>\w+)", "reason": "began {p}"}],
        "end_points": [{"filter": f"message like '%{end}%'", "regex": r"p=(?P<p>\w+)(?: s=(?P<s>\w+))?"}],
        "correlate": list(correlate),
        "template": {"name": "{p} {nope}", "description": "{start_reason}"},
        **({"timeout": timeout} if timeout else {}),
        **({"timeout_reason": timeout_reason} if timeout_reason else {}),
    }


def model(rows, correlate, timeout, oldest=False):
    """One rule, record by record: a list of waiting starts."""
    waiting, out = [], []
    for i, (t, m) in enumerate(rows):
        p = m.split("p=")[1].split()[0] if "p=" in m else None
        if "end" in m:
            for k in range(len(waiting)) if oldest else range(len(waiting) - 1, -1, -1):
                wi, wt, wp = waiting[k]
                if timeout is not None and t - wt >= timeout:
                    continue
                if not correlate or (wp is not None and wp == p):
                    out.append((wi, i, False))
                    del waiting[k]
                    break
        if "start" in m:
            if timeout is not None:
                out += [(wi, wi, True) for wi, wt, _ in waiting if t - wt >= timeout]
                waiting = [w for w in waiting if t - w[1] < timeout]
            waiting.append((i, t, p))
    return sorted(out), sorted(w[0] for w in waiting)


def random_rows(rng, n):
    t, rows = 0, []
    for _ in range(n):
        t += rng.choice([0, 0, 1, 2, 5])
        kind = rng.choice(["start", "end", "start end", "other", "start", "end"])
        key = rng.choice([" p=a", " p=b", " p=a", ""])
        rows.append((t, kind + key))
    return rows


def test_random_events_match_the_model(spark, small_chunks):
    rng = random.Random(7)
    cases = [((), None), (("p",), None), ((), 6), (("p",), 6), (("p",), 3)]
    for correlate, timeout in cases:
        rows = random_rows(rng, 150)
        rules = region_rules({"regions": [rule(correlate=correlate, timeout=f"{timeout}s" if timeout else None)]})
        spans = pair_regions(tag_points(logs_of(spark, rows), rules), rules)
        got = [
            (r.start_index, r.end_index, r.status == "timed_out")
            for r in spans.filter("status <> 'open'").select("start_index", "end_index", "status").collect()
        ]
        want, waiting = model(rows, correlate, timeout)
        assert sorted(got) == want, (correlate, timeout)
        assert sorted(r.start_index for r in open_regions(spans).collect()) == waiting


def test_oldest_first_with_a_timeout_matches_the_model(spark, small_chunks):
    rng = random.Random(11)
    for correlate, timeout in (((), 6), (("p",), 6), (("p",), 3)):
        rows = random_rows(rng, 120)
        raw = {**rule(correlate=correlate, timeout=f"{timeout}s"), "pairing": "oldest"}
        rules = region_rules({"regions": [raw]})
        spans = pair_regions(tag_points(logs_of(spark, rows), rules), rules)
        done = spans.filter("status <> 'open'").select("start_index", "end_index", "status").collect()
        want, waiting = model(rows, correlate, timeout, oldest=True)
        assert sorted((r.start_index, r.end_index, r.status == "timed_out") for r in done) == want, (correlate, timeout)
        assert sorted(r.start_index for r in open_regions(spans).collect()) == waiting


def test_lookups_with_nested_and_long_regions(spark, small_chunks):
    """One region over everything, many nested ones, and all times equal."""
    n = 60
    logs = logs_of(spark, [(0, "x")] * n)
    spans = [(0, n - 1)] + [(i, n - 1 - i) for i in range(1, n // 2)] + [(5, 5), (40, 41)]
    cols = "start_index bigint, end_index bigint, rule_ord int, close_index bigint, definition_name string, name string, timed_out boolean"
    found = spark.createDataFrame([(a, b, k, b, "d", str(k), False) for k, (a, b) in enumerate(spans)], cols)
    pairs = {(r.record_index, r.region.start_index, r.region.end_index) for r in rl.regions_at(logs, found).collect()}
    assert pairs == {(i, a, b) for i in range(n) for a, b in spans if a <= i <= b}
    best = {r.record_index: (r.region.start_index, r.region.end_index) for r in rl.innermost_region(logs, found).collect()}
    assert best == {i: min(((b - a, a, b) for a, b in spans if a <= i <= b))[1:] for i in range(n)}


def test_two_rules_do_not_mix(spark, small_chunks):
    rows = [(0, "start p=a"), (1, "begin p=a"), (2, "end p=a"), (3, "stop p=a")]
    rules = region_rules({"regions": [rule("one"), rule("two", start="begin", end="stop")]})
    got = {(r.definition_name, r.start_index, r.end_index) for r in regions(logs_of(spark, rows), rules).collect()}
    assert got == {("one", 0, 2), ("two", 1, 3)}


def test_crossing_ports(spark):
    rows = [(0, "start p=e0"), (1, "start p=e4"), (2, "end p=e4"), (3, "end p=e0")]
    rules = region_rules({"regions": [rule()]})
    got = regions(logs_of(spark, rows), rules).orderBy("start_index").collect()
    assert [(r.start_index, r.end_index) for r in got] == [(0, 3), (1, 2)]
    assert got[0].name == "e0 {nope}" and got[0].description == "began e0"
    assert got[0].metadata == {"p": "e0", "start_reason": "began e0"}


def test_timeout_row(spark):
    rows = [(1000, "start p=a"), (1060, "start p=a"), (1062, "end p=a s=up")]
    rules = region_rules({"regions": [rule(timeout="30s", timeout_reason="gave up on {p}")]})
    got = regions(logs_of(spark, rows), rules).orderBy("start_index").collect()
    assert [(r.start_index, r.end_index, r.timed_out) for r in got] == [(0, 0, True), (1, 2, False)]
    assert got[0].end_reason == "gave up on a" and got[0].close_index == 1
    assert got[1].metadata["s"] == "up" and got[1].end_reason is None


def test_end_without_regex_match_closes_only_uncorrelated(spark):
    rows = [(0, "start p=a"), (1, "end")]
    for correlate, n in ((("p",), 0), ((), 1)):
        rules = region_rules({"regions": [rule(correlate=correlate)]})
        assert regions(logs_of(spark, rows), rules).count() == n


def test_oldest_first(spark, small_chunks):
    rng = random.Random(3)
    rows = random_rows(rng, 80)
    raw = rule(correlate=())
    raw["pairing"] = "oldest"
    rules = region_rules({"regions": [raw]})
    queue, want = [], []
    for i, (_, m) in enumerate(rows):
        if "end" in m and queue:
            want.append((queue.pop(0), i))
        if "start" in m:
            queue.append(i)
    got = regions(logs_of(spark, rows), rules).select("start_index", "end_index").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def make_regions(spark, spans):
    rows = [(f"t{i % 3}", f"n{i}", s, e, False, i % 3, e) for i, (s, e) in enumerate(spans)]
    return spark.createDataFrame(
        rows,
        "definition_name string, name string, start_index bigint, end_index bigint, timed_out boolean, rule_ord int, close_index bigint",
    )


def test_lookups_match_brute_force(spark, small_chunks):
    rng = random.Random(11)
    n = 70
    spans = {(i % 3, s): (s, min(n - 1, s + rng.choice([0, 1, 3, 9, 40]))) for i, s in enumerate(rng.choices(range(n), k=30))}
    spans = sorted(spans.values())
    found = make_regions(spark, spans)
    logs = spark.range(n).select(F.col("id").alias("record_index"))
    listed = [(r, i) for i, r in enumerate(spans)]
    at = rl.regions_at(logs, found).select("record_index", "region.start_index", "region.end_index").collect()
    assert sorted(map(tuple, at)) == sorted((i, s, e) for i in range(n) for s, e in spans if s <= i <= e)
    inner = {r.record_index: r.region for r in rl.innermost_region(logs, found).collect()}
    marks = {r.record_index: r.marker for r in rl.mark_regions(logs, found).collect()}
    for i in range(n):
        inside = [((e - s, s, e, k % 3), (s, e)) for (s, e), k in listed if s <= i <= e]
        if not inside:
            assert inner[i] is None and marks[i] == "none"
        else:
            s, e = min(inside)[1]
            assert (inner[i].start_index, inner[i].end_index) == (s, e)
            assert marks[i] == ("start" if i == s else "end" if i == e else "inside")
    kept = sorted(r.record_index for r in rl.filter_in_regions(logs, found, type="t1").collect())
    assert kept == [i for i in range(n) if any(s <= i <= e for k, (s, e) in enumerate(spans) if k % 3 == 1)]
    nxt = {r.record_index: r.next_start for r in rl.next_region(logs, found).collect()}
    assert nxt == {i: min((s for s, _ in spans if s > i), default=None) for i in range(n)}


def test_no_table_that_grows_is_sent_to_every_task(spark, small_chunks):
    """Rows made by ``explode`` from small files do not count in Spark's estimate; they are joined by shuffle."""
    n = 400
    found = make_regions(spark, [(i, i + 1 + i % 30) for i in range(0, n - 40, 2)])
    logs = spark.range(n).select(F.col("id").alias("record_index"))
    plan = rl.innermost_region(logs, found)._jdf.queryExecution().optimizedPlan().toString()
    sides = [line for line in plan.splitlines() if "Join" in line and "size" in line]
    assert sides and all("strategy=merge" in line or "strategy=broadcast" in line for line in sides), sides
    at = rl.regions_at(logs, found)._jdf.queryExecution().optimizedPlan().toString()
    assert at.count("Join ") == 1 and "strategy=merge" in at  # pairs are made once and not joined again


def test_regions_at_with_one_long_and_many_short(spark, monkeypatch):
    """Blocks listed in two steps, other columns kept, an end before its start holds nothing."""
    monkeypatch.setattr(rl, "SPREAD_BITS", 2)
    n = 300
    spans = [(0, n - 1)] + [(i, i) for i in range(0, n, 3)] + [(20, 10), (290, 400)]
    logs = spark.range(n).select(F.col("id").alias("record_index"), (F.col("id") * 2).alias("start_index"))
    got = rl.regions_at(logs, make_regions(spark, spans)).select("record_index", "start_index", "region.name").collect()
    assert sorted(map(tuple, got)) == sorted((i, 2 * i, f"n{k}") for i in range(n) for k, (s, e) in enumerate(spans) if s <= i <= e)


@pytest.mark.parametrize("few", [0, 4])
def test_regions_at_steps_through_blocks(spark, monkeypatch, few):
    """Pairs are made from the arrays of a block and not row by row in the join; repeated positions and nulls stay."""
    monkeypatch.setattr(rl, "FEW_COLUMNS", few, raising=False)
    monkeypatch.setattr(rl, "BLOCK_BITS", 5, raising=False)
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(200)]), rng.choice([None, i]), rng.choice([None, {"k": str(i)}])) for i in range(300)]
    spans = [(s, s + rng.choice([0, 1, 5, 150])) for s in rng.sample(range(200), 60)]
    at = rl.regions_at(spark.createDataFrame(rows, "record_index long, id long, metadata map<string,string>"), make_regions(spark, spans))
    got = [(r.record_index, r.id, str(r.metadata), r.name) for r in at.select("record_index", "id", "metadata", "region.name").collect()]
    want = [(p, i, str(m), f"n{k}") for p, i, m in rows for k, (s, e) in enumerate(spans) if p is not None and s <= p <= e]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 3000
    joins = [line for line in at._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert len(joins) == 1 and "start_index" not in joins[0], joins


def test_oldest_in_time_with_many_keys_in_one_pass(spark, small_chunks):
    """Many small keys beside each other in a partition: no call a key, and none takes another's starts."""
    rng = random.Random(5)
    rows = [(i // 3, f"{rng.choice(['start', 'end'])} p=k{rng.randrange(40)}") for i in range(400)]
    raw = {**rule(timeout="60s"), "pairing": "oldest"}
    rules = region_rules({"regions": [raw]})
    spans = pair_regions(tag_points(logs_of(spark, rows), rules), rules)
    done = spans.filter("status <> 'open'").select("start_index", "end_index", "status").collect()
    want, _ = model(rows, ("p",), 60, oldest=True)
    assert sorted((r.start_index, r.end_index, r.status == "timed_out") for r in done) == want
