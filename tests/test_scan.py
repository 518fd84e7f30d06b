import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweft.operators import ordering as od
from logweft.operators import search as se
from logweft.operators.chain import carry_request_context
from logweft.operators.multiline import merge_multiline
from logweft.plans.asof import nearest_in_time
from logweft.plans.scan import Scan, index_chunk, scan


def test_scans_equal_plain_windows(spark, small_chunks):
    rng = random.Random(1)
    rows = [(i, rng.choice("xy"), rng.choice([None, 1, 2, 7])) for i in range(90)]
    df = spark.createDataFrame(rows, "i bigint, g string, v int").withColumn("c", F.shiftright("i", 2))
    kinds = [(k, inc, back) for k in ("sum", "min", "max", "last") for inc in (True, False) for back in (True, False)]
    scans = [Scan(f"o{n}", F.col("v"), k, inc, back) for n, (k, inc, back) in enumerate(kinds)]
    got = scan(df, scans, by=["g"], chunks=["c"], order=["i"])
    for n, (k, inc, back) in enumerate(kinds):
        w = W.partitionBy("g").orderBy(F.col("i").desc() if back else F.col("i")).rowsBetween(
            W.unboundedPreceding, 0 if inc else -1
        )
        agg = F.last("v", ignorenulls=True) if k == "last" else getattr(F, k)("v")
        got = got.withColumn(f"w{n}", agg.over(w))
    bad = got.filter(" OR ".join(f"NOT (o{n} <=> w{n})" for n in range(len(kinds)))).collect()
    assert bad == []


def test_record_index_with_ties(spark):
    rows = [(i, 1_000_000 * (i * 7 % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, us bigint").withColumn("timestamp", F.timestamp_micros("us"))
    got = [r.id for r in od.with_record_index(df).orderBy("record_index").collect()]
    assert got == [i for i, us in sorted(rows, key=lambda r: (r[1], r[0]))]


def test_nearest_in_time(spark):
    rng = random.Random(5)
    marks = sorted(rng.choices(range(0, 400_000_000, 250_000), k=50))
    probes = rng.choices(range(0, 400_000_000, 250_000), k=40)
    m = spark.createDataFrame(list(enumerate(marks)), "i bigint, us bigint").withColumn("t", F.timestamp_micros("us"))
    p = spark.createDataFrame([(x,) for x in probes], "us bigint").withColumn("at", F.timestamp_micros("us"))
    out = nearest_in_time(p, m, probe_ts="at", mark_ts="t", mark_index="i")
    got = {r.us: (r.prev_index, r.next_index) for r in out.withColumn("us", F.unix_micros("at")).collect()}
    for x in set(probes):
        before = [i for i, t in enumerate(marks) if t < x]
        after = [i for i, t in enumerate(marks) if t >= x]
        assert got[x] == (before[-1] if before else None, after[0] if after else None)


def test_jump_prefers_the_earlier_on_a_tie(spark):
    df = spark.createDataFrame([(0, 0), (1, 4), (2, 6)], "record_index bigint, s bigint").select(
        "record_index", F.timestamp_seconds("s").alias("timestamp")
    )
    got = {r.anchor_index: r.record_index for r in od.jump_relative(df, df, "5s").collect()}
    assert got == {0: 1, 1: 2, 2: 2}
    back = {r.anchor_index: r.record_index for r in od.jump_relative(df, df, "5s", forward=False).collect()}
    assert back == {0: 0, 1: 0, 2: 0}


def test_positions_over_chunks(spark, small_chunks):
    df = spark.range(40).select(F.col("id").alias("record_index"), F.col("id"))
    hits = [3, 9, 10, 31]
    cond = F.col("record_index").isin(*hits)
    view = {r.record_index: r.view_index for r in od.with_view_index(df, cond).collect()}
    assert view == {h: k for k, h in enumerate(hits)}
    near = {r.record_index: r.nearest_index for r in od.nearest_preceding(df, cond).collect()}
    assert all(near[i] == max([h for h in hits if h <= i], default=3) for i in range(40))
    jumps = {r.record_index: (r.next_match, r.prev_match) for r in se.next_prev_match(df, cond).collect()}
    for i in range(40):
        assert jumps[i] == (min([h for h in hits if h >= i], default=3), max([h for h in hits if h < i], default=31))
    late = spark.createDataFrame([(i, t) for i, t in enumerate([5, 6, 1, 7, 7, 2, 9, 9, 8])], "id bigint, s bigint")
    late = late.withColumn("timestamp", F.timestamp_seconds("s"))
    flags = [r.out_of_order for r in od.flag_out_of_order(late).orderBy("id").collect()]
    assert flags == [False, False, True, False, False, True, False, False, True]


def test_carry_over_chunks(spark, small_chunks):
    rng = random.Random(2)
    rows, last, want = [], None, {}
    for i in range(60):
        fn = rng.choice(["Get", "GetResponse", "Set", "Set"])
        ctx = rng.choice([None, "a", "b"]) if fn == "Get" else None
        if fn == "Get":
            last = ctx
        want[i] = last if fn == "GetResponse" else ctx
        rows.append(("s", i // 20, i, fn, ctx, None))
    df = spark.createDataFrame(
        rows, "source string, block_start bigint, seq bigint, function string, context string, component_name string"
    )
    got = {r.seq: r.context for r in carry_request_context(df).collect()}
    assert got == want


def test_multiline(spark, small_chunks):
    text = ["orphan 1", "orphan 2", "2024 a", " at x", " at y", "2024 b", "2024 c"] + [" more"] * 9
    rows = [("l", "s", i // 8, i, t, 2024) for i, t in enumerate(text)]
    df = spark.createDataFrame(
        rows, "loader_id string, source string, block_start bigint, seq bigint, line string, mod_year int"
    )
    got = [r.line for r in merge_multiline(df, r"^\d{4}").orderBy("block_start", "seq").collect()]
    assert got == ["orphan 1\norphan 2", "2024 a\n at x\n at y", "2024 b", "\n".join(["2024 c"] + [" more"] * 9)]


def test_chunk_is_even(spark):
    assert spark.range(0, 5 << 20, 1 << 19).select(index_chunk("id").alias("c")).groupBy("c").count().select(
        F.max("count")
    ).first()[0] == 2
