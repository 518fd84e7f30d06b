"""Files of several kinds in, tables and files out."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from logweft.operators.sinks import write_json, write_raw, write_records, write_yaml
from logweft.plans.pipe import pipe
from logweft.rules import category_rules, parser_rules, region_rules
from logweft.schema import LOG_COLUMNS, LOG_SCHEMA
from logweft.sources.load import read_logs
from logweft.sources.text import read_lines

GENERIC = [
    "2024-01-15 10:00:00 INFO Starting application",
    "2024-01-15 10:00:01 WARN Low memory",
    "2024-01-15 10:00:02 ERROR Failed, badly",
    "2024-01-15 10:00:03 DEBUG details",
    "2024-01-15 10:00:04 ERROR Fatal problem",
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.log").write_text("\n".join(GENERIC) + "\n")
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("Feb 19 14:23:45 h p[1]: one\r\n\nFeb 19 14:23:46 h p: two\n")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x.log", '{"message":"j1"}\n{"message":"j2"}\n')
        z.writestr("d/", "")
        z.writestr("d/y.log", '{"message":"j3"}')
    with gzip.open(tmp_path / "e.gzip", "wt") as f:
        f.write("2025-05-18.06:38:35.610696|g|T:oid:1|A=1\n2025-05-18.06:38:36.1|G|OK|A=2\n")
    return tmp_path


def test_read_lines_keeps_empty_lines_and_strips_cr(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"a\r\n\nb\rc\r\r\nlast")
    rows = read_lines(spark, str(tmp_path / "x.log")).orderBy("block_start", "seq").collect()
    assert [r.line for r in rows] == ["a", "", "b\rc\r", "last"]
    assert rows[0].mod_year >= 2024


def test_order_survives_splits(spark, tmp_path):
    n = 3000
    (tmp_path / "x.log").write_text("".join(f"line {i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = read_lines(spark, str(tmp_path / "x.log"))
        assert lines.rdd.getNumPartitions() > 2
        logs = read_logs(spark, str(tmp_path / "x.log"), formats="generic", ingest_ts="2024-01-01T00:00:00Z")
        got = logs.select("id", "message").orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in got] == [(i, f"line {i}") for i in range(n)]


def test_many_inputs(spark, folder):
    patterns = [f"{folder}/*.log", f"{folder}/nothing*", f"{folder}/*.gz", f"{folder}/*.zip", f"{folder}/*.gzip"]
    logs = read_logs(spark, patterns, ingest_ts="2030-01-01T00:00:00Z").orderBy("id").collect()
    assert [r.id for r in logs] == list(range(12))
    assert [r.message for r in logs[5:]] == ["one", "two", "j1", "j2", "j3", "A=1", "OK|A=2"]
    assert logs[0].level == "INFO" and logs[5].hostname == "h" and logs[5].pid == 1
    assert logs[11].context == "oid:1" and logs[11].component_name == "T"
    assert logs[7].timestamp.year == 2030
    assert read_logs(spark, f"{folder}/none*").count() == 0


def test_pipe_and_sinks(spark, folder):
    include = [{"any": [{"field": "level", "op": "==", "value": "ERROR"}, {"field": "level", "op": "==", "value": "WARN"}]}]
    out = str(folder / "out")
    kept = pipe(spark, f"{folder}/a.log", include, fmt="csv", fields=["level", "msg", "absent"], out=out)
    assert kept.count() == 3
    text = [r.value for r in spark.read.text(out).collect()]
    assert text[0] == "level,msg,absent" and 'Error,"Failed, badly",' in text
    with pytest.warns(UserWarning):
        assert pipe(spark, f"{folder}/a.log", ["nonsense ((", *include]).count() == 3
    write_raw(kept, f"{out}-raw")
    assert sorted(r.value for r in spark.read.text(f"{out}-raw").collect()) == sorted(GENERIC[i] for i in (1, 2, 4))
    write_json(kept, f"{out}-json", ["msg", "level"])
    assert '{"level":"Warn","msg":"Low memory"}' in [r.value for r in spark.read.text(f"{out}-json").collect()]
    write_yaml(kept.withColumn("message", F.lit('say "x"')), f"{out}-yaml", ["msg"])
    assert [r.value for r in spark.read.text(f"{out}-yaml").limit(2).collect()] == ["---", 'msg: "say \\"x\\""']
    for fmt in ("json", "yaml", "parquet"):
        write_records(kept.select(*[c for c in LOG_COLUMNS]), f"{out}-{fmt}-all", fmt)
    yaml = pytest.importorskip("yaml")
    text = "\n".join(r.value for r in spark.read.text(f"{out}-yaml-all").collect())
    assert {r["message"] for r in yaml.safe_load(text)} == {"Low memory", "Failed, badly", "Fatal problem"}


def test_rule_files(spark):
    pytest.importorskip("yaml")
    with pytest.warns(UserWarning):
        rules = category_rules(
            spark,
            "categories:\n - name: a\n   filter: \"level = 'ERROR'\"\n - name: b\n   filter: 'nope (('\n - {name: c, filter: {field: pid, op: '>', value: 3}}\n",
        )
    assert [n for n, _ in rules] == ["a", "c"]
    groups = parser_rules("groups:\n - name: g\n   parsers:\n    - {name: p, pattern: '(?P<message>.*)'}\n")
    assert groups["g"][0].pattern == "(?P<message>.*)"
    with pytest.raises(ValueError):
        parser_rules("groups:\n - name: g\n   parsers:\n    - {name: p, pattern: '('}\n")
    with pytest.raises(ValueError):
        region_rules("regions:\n - {name: x}\n")


def test_two_valued_logic(spark):
    from logweft.operators.predicates import log_cmp

    rows = [(1, "10", None), (2, "9", "x"), (3, "1d", "y"), (4, "NaN", "x")]
    base = spark.createDataFrame([], LOG_SCHEMA)
    df = base.unionByName(spark.createDataFrame(rows, "id long, message string, context string"), allowMissingColumns=True)
    ids = lambda c: sorted(r.id for r in df.filter(c).collect())
    assert ids(log_cmp("context", "!=", "x")) == [3]
    assert ids(~log_cmp("context", "==", "x")) == [1, 3]
    assert ids(log_cmp("message", ">", "9")) == [1, 4]
    assert ids(log_cmp("message", "<", "9.5")) == [2, 3]
    assert ids(log_cmp("id", ">=", "3")) == [3, 4] and ids(log_cmp("id", ">", "2.5")) == [3, 4]
    assert ids(log_cmp("message", "regex", "(bad")) == []
