"""Stores of sorted files: lookups read few of them, late rows touch few of them."""

import random

from pyspark.sql import functions as F

from logweft.plans import segments as sg
from logweft.streaming.operators import keep_sorted, sorted_store, waiting_rows

ORDER = ("timestamp", "id")
AT = "timestamp_seconds(s + 1700000000) AS timestamp"


def _table(spark, seconds, first=0):
    return spark.createDataFrame([(first + i, s) for i, s in enumerate(seconds)], "id bigint, s bigint").selectExpr("id", AT)


def _files(df):
    return len(df.inputFiles())


def test_lookups_read_few_files(spark):
    counts = {}
    for n in (2000, 20_000):
        spark.conf.set("spark.sql.shuffle.partitions", str(n // 250))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            rows = spark.range(n).select(F.col("id"), F.timestamp_seconds(F.floor(F.col("id") * 37 % n / 3) + 1_700_000_000).alias("timestamp"))
            store = sg.write_store(rows, ORDER)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert sg.size_of(store) == n and store.fences.count() >= n // 400
        want = sorted((r.timestamp, r.id) for r in rows.collect())
        got = sg.with_positions(store).orderBy("record_index").collect()
        assert [(r.timestamp, r.id) for r in got] == want and [r.record_index for r in got] == list(range(n))
        for second in (-5, 0, 77, n // 3, n):
            ts = spark.range(1).select(F.timestamp_seconds(F.lit(second + 1_700_000_000))).first()[0]
            found = sg.find_by_time(store, ts)
            assert found.first()[0] == sum(t < ts for t, _ in want)
            assert _files(found) <= 1
        part = sg.range_by_position(store, 500, 700)
        assert [(r.timestamp, r.id) for r in part.orderBy("record_index").collect()] == want[500:700]
        ts = [spark.range(1).select(F.timestamp_seconds(F.lit(s + 1_700_000_000))).first()[0] for s in (100, 120)]
        piece = sg.time_slice(store, *ts)
        assert sorted(r.id for r in piece.collect()) == sorted(i for t, i in want if ts[0] <= t < ts[1])
        counts[n] = _files(part.select("id")), _files(piece.select("id"))
    assert max(counts[20_000]) <= max(counts[2000]) + 2  # ten times the rows, as many files


def test_late_rows_touch_their_files_only(spark, tmp_path):
    store = sg.write_store(_table(spark, range(0, 4000, 2)), ORDER, str(tmp_path / "store"))
    before = {r.file: (r.lo, r.hi) for r in store.fences.collect()}
    late = _table(spark, [1001, 1001, 1003, -7, 1500], first=10_000)
    merged = sg.merge_late(store, late, ORDER, str(tmp_path / "merged"))
    after = {r.file for r in merged.fences.collect()}
    times = {r.timestamp for r in late.collect()}
    lowest = min(lo for lo, _ in before.values())
    touched = {f for f, (lo, hi) in before.items() if any(lo <= t <= hi for t in times) or lo == lowest}
    assert set(before) - after <= touched and len(set(before) & after) >= len(before) - 3
    rows = sg.with_positions(merged).orderBy("record_index").collect()
    assert [(r.timestamp, r.id) for r in rows] == sorted((r.timestamp, r.id) for r in store_rows(spark, store).unionByName(late).collect())
    assert [r.record_index for r in rows] == list(range(2005))


def store_rows(spark, store):
    return sg.with_positions(store).drop("record_index")


def test_stream_is_kept_in_time_order(spark, tmp_path):
    """Batches with rows of any age: nothing is lost, stored files never overlap, and untouched files stay."""
    rnd = random.Random(4)
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    rows, files = [], []
    for k in range(4):
        part = [(len(rows) + i, 1000 * k + rnd.randrange(-900 if k == 2 else -40, 1000)) for i in range(300)]
        rows += part
        spark.createDataFrame(part, "id bigint, s bigint").selectExpr("id", AT).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id bigint, timestamp timestamp").parquet(src)
        keep_sorted(stream, out, state, ORDER, threshold=60).awaitTermination()
        store, waiting = sorted_store(spark, state, stream.schema), waiting_rows(spark, state, stream.schema)
        fences = store.fences.orderBy("first").collect()
        assert all(a.hi <= b.lo for a, b in zip(fences, fences[1:]))
        assert waiting.count() < 60 and sg.size_of(store) + waiting.count() == len(rows)
        files.append({f.file for f in fences})
    assert any(a & b for a, b in zip(files, files[1:]))
    done = sg.merge_late(store, waiting, ORDER, str(tmp_path / "last")) if waiting.count() else store
    got = sg.with_positions(done).orderBy("record_index").collect()
    assert [r.id for r in got] == [i for _, i in sorted((s, i) for i, s in rows)]
    spark.createDataFrame([], "id bigint, timestamp timestamp").coalesce(1).write.mode("append").parquet(src)
    keep_sorted(stream, out, state, ORDER, threshold=60).awaitTermination()
    assert sg.size_of(sorted_store(spark, state, stream.schema)) == sg.size_of(store)
