"""Streams continue where they stopped."""

from pyspark.sql import functions as F

from logweft.operators.regions import regions
from logweft.rules import region_rules
from logweft.sources.tables import as_logs
from logweft.sources.load import read_logs
from logweft.streaming.follow import follow, follow_current, followed, restart
from logweft.streaming.operators import keep_late, merged
from logweft.streaming.regions import closed_regions, stream_regions


def test_ids_continue_and_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    for n in range(2):
        (src / f"{n}.log").write_text(f"2024-01-15 10:00:0{n} INFO a{n}\n\n2024-01-15 10:00:0{n} WARN b{n}\n")
        follow(spark, str(src), "generic", out, checkpoint).awaitTermination()
    rows = followed(spark, out).orderBy("id").collect()
    assert [(r.id, r.message) for r in rows] == [(0, "a0"), (1, "b0"), (2, "a1"), (3, "b1")]
    (src / "0.log").unlink()
    (src / "1.log").write_text("2024-01-15 11:00:00 INFO new\n")
    query, fresh = restart(spark, str(src), "generic")
    query.awaitTermination()
    assert [(r.id, r.message) for r in followed(spark, fresh).collect()] == [(0, "new")]
    assert followed(spark, out).count() == 4


def test_regions_over_batches(spark, tmp_path):
    rules = region_rules(
        {
            "regions": [
                {
                    "name": "r",
                    "start_points": [{"filter": "message like 'start%'", "regex": r"p=(?P<p>\w+)"}],
                    "end_points": [{"filter": "message like 'end%'", "regex": r"p=(?P<p>\w+)"}],
                    "correlate": ["p"],
                    "template": {"name": "{p}"},
                    "timeout": "30s",
                }
            ]
        }
    )
    rows = [(0, "start p=a"), (1, "start p=b"), (2, "end p=b"), (10, "end p=a"), (11, "start p=c"), (60, "start p=d"), (61, "end p=d")]
    src = str(tmp_path / "in")
    schema = "s bigint, message string"
    columns = {"id": F.col("s"), "timestamp": F.timestamp_seconds(F.col("s") + 1_700_000_000), "message": "message"}
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(src)
        stream = as_logs(spark.readStream.schema(schema).parquet(src), columns)
        stream_regions(stream, rules, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = closed_regions(spark, str(tmp_path / "out"))
    numbered = [(i, *r) for i, r in enumerate(rows)]
    table = spark.createDataFrame(numbered, f"record_index bigint, {schema}")
    logs = table.select("record_index", columns["timestamp"].alias("timestamp"), "message")
    pick = ["name", "start_index", "end_index", "timed_out", "close_index"]
    want = regions(logs, rules)
    show = lambda df: sorted(tuple(r) for r in df.select(*pick).collect())
    assert show(got) == show(want) == [("a", 0, 3, False, 3), ("b", 1, 2, False, 2), ("c", 4, 4, True, 5), ("d", 5, 6, False, 6)]


def test_lines_of_blanks_stay(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("2024-01-15 10:00:00 INFO one\n   \n\n2024-01-15 10:00:01 INFO two\n")
    follow(spark, str(src), "generic", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r.message for r in followed(spark, str(tmp_path / "out")).orderBy("id").collect()] == ["one", "   ", "two"]
    batch = read_logs(spark, [str(src / "*.log")], formats="generic").filter("message <> ''")
    assert [r.message for r in batch.orderBy("id").collect()] == ["one", "   ", "two"]


def test_state_stays_small_over_many_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(12):
        (src / f"{n:02d}.log").write_text(f"2024-01-15 10:00:{n:02d} INFO m{n}\n")
    state = tmp_path / "state"
    follow(spark, str(src), "generic", str(tmp_path / "out"), str(state), maxFilesPerTrigger="1").awaitTermination()
    rows = followed(spark, str(tmp_path / "out")).collect()
    assert sorted(r.id for r in rows) == list(range(12))
    assert len(list((state / "ids").glob("batch=*"))) == 2


def test_a_replaced_source_starts_over(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "base")
    src.mkdir()

    def run():
        query, out = follow_current(spark, str(src), "generic", base)
        query.awaitTermination()
        return out, [(r.id, r.message) for r in followed(spark, out).orderBy("id").collect()]

    (src / "a.log").write_text("2024-01-15 10:00:00 INFO a\n")
    first, rows = run()
    assert rows == [(0, "a")]
    (src / "b.log").write_text("2024-01-15 10:00:01 INFO b\n")
    assert run() == (first, [(0, "a"), (1, "b")])
    (src / "b.log").unlink()  # rotated away: nothing changes
    assert run() == (first, [(0, "a"), (1, "b")])
    (src / "a.log").write_text("2024-01-15 11:00:00 INFO new content\n")
    again, rows = run()
    assert again != first and rows == [(0, "new content")]


def test_late_rows_are_kept_and_merged(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "s bigint"
    columns = {"id": F.col("s"), "timestamp": F.timestamp_seconds(F.col("s") + 1_700_000_000)}
    for rows in ([100, 50, 200], [150, 300], [10, 299, 400]):
        spark.createDataFrame([(x,) for x in rows], schema).coalesce(1).write.mode("append").parquet(src)
        stream = as_logs(spark.readStream.schema(schema).parquet(src), columns)
        keep_late(stream, "30s", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.id: r.late for r in merged(spark, str(tmp_path / "out"), stream.schema).collect()}
    assert got == {100: False, 50: False, 200: False, 150: True, 300: False, 10: True, 299: False, 400: False}


def test_lines_appended_in_pieces(spark, tmp_path):
    """A file that grows by parts of lines over 20 batches gives each line once; a truncated one starts over."""
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    text = "".join(f"2024-01-15 10:00:{n:02d} INFO zeile {n} \u00e4\u20ac\r\n" + "\n" * (n % 3) for n in range(40)).encode()

    def run():
        follow(spark, str(src), "generic", out, state, growing=True, blockBytes="40").awaitTermination()
        return [(r.id, r.message) for r in followed(spark, out).orderBy("id").collect()]

    ends = [len(text) * k // 20 for k in range(1, 21)]
    for k, end in enumerate(ends):
        (src / "a.log").write_bytes(text[:end])
        if k == 7:
            (src / "b.log").write_bytes(b"2024-01-15 11:00:00 INFO beside\n2024-01-15 11:00:01 INFO unfin")
        if k in (0, 7, 19):
            have = run()
            wanted = text[:end].rpartition(b"\n")[0].count(b"zeile") + (k >= 7)
            assert [i for i, _ in have] == list(range(wanted))
    messages = [m for _, m in run()]
    assert sorted(messages) == sorted([f"zeile {n} \u00e4\u20ac" for n in range(40)] + ["beside"])
    (src / "b.log").write_bytes(b"2024-01-15 11:00:00 INFO beside\n2024-01-15 11:00:01 INFO unfinished\n")
    assert run()[-1] == (41, "unfinished")
    (src / "b.log").write_bytes(b"2024-01-15 11:00:00 INFO beside\n")  # shorter: replaced, read again
    assert run()[-1] == (42, "beside")
    (src / "b.log").write_bytes(b"2024-01-15 11:00:00 INFO beside\n2024-01-15 11:00:09 INFO more\n")
    (src / "a.log").unlink()
    assert run()[-1] == (43, "more")
    # Longer than before, but the bytes before the old end are others.
    (src / "b.log").write_bytes(b"2024-01-15 11:00:00 INFO beside\n2024-01-15 11:00:09 INFO MORE\n2024-01-15 11:00:10 INFO x\n")
    assert [m for _, m in run()[44:]] == ["beside", "MORE", "x"]


def test_growth_is_no_replacement(spark, tmp_path):
    src, base = tmp_path / "in", str(tmp_path / "base")
    src.mkdir()

    def run():
        query, out = follow_current(spark, str(src), "generic", base)
        query.awaitTermination()
        return out, [(r.id, r.message) for r in followed(spark, out).orderBy("id").collect()]

    (src / "a.log").write_text("2024-01-15 10:00:00 INFO a\n")
    first, _ = run()
    with (src / "a.log").open("a") as f:
        f.write("2024-01-15 10:00:01 INFO b\n2024-01-15 10:00:02 IN")
    assert run() == (first, [(0, "a"), (1, "b")])
    with (src / "a.log").open("a") as f:
        f.write("FO c\n")
    assert run() == (first, [(0, "a"), (1, "b"), (2, "c")])
    (src / "a.log").write_text("2024-01-15 10:00:00 INFO a\n")
    again, rows = run()
    assert again != first and rows == [(0, "a")]
