"""Sample lines of every layout with the expected fields."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweft.functions.durations import duration_ms, fmt_duration, parse_duration, timeout_seconds
from logweft.functions.regex import search, translate
from logweft.operators import parsers as P
from logweft.operators.chain import carry_request_context, detect_formats, expand_attributes, parse_chain
from logweft.operators.json_log import expand_json, parse_json_log
from logweft.sources.otlp import otlp_records


def parse(spark, parser, lines, year=2026):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.p for r in df.select("i", parser(F.col("line"), F.lit(year)).alias("p")).orderBy("i").collect()]


def utc(*a):
    return datetime(*a)


def test_bsd(spark):
    ok, padded, bad_pid, bad_day, short, no_colon, empty_msg, empty_host = parse(
        spark,
        P.parse_syslog_bsd,
        [
            "Feb 19 14:23:45 myhost myapp[12345]: This is a log message",
            "Jan  5 03:00:00 server sshd: Connection closed",
            "Feb 19 14:23:45 myhost myapp[abc]: msg",
            "Feb X9 14:23:45 host proc[1]: msg",
            "Feb 19",
            "Feb 19 14:23:45 myhost no message here",
            "Feb 19 14:23:45 h p[]: ",
            "Feb 19 14:23:45  p: x: y",
        ],
    )
    assert (ok.hostname, ok.process_name, ok.pid, ok.level) == ("myhost", "myapp", 12345, None)
    assert ok.timestamp == utc(2026, 2, 19, 14, 23, 45) and ok.message == "This is a log message"
    assert padded.pid is None and padded.timestamp == utc(2026, 1, 5, 3, 0, 0)
    assert (bad_pid.process_name, bad_pid.pid) == ("myapp", None)
    assert bad_day is None and short is None and no_colon is None
    assert (empty_msg.message, empty_msg.pid) == ("", 0)
    assert (empty_host.hostname, empty_host.process_name, empty_host.message) == ("", "p", "x: y")


def test_bad_clocks_are_refused(spark):
    lines = ["Feb 19 1:23:4.5 h p: m", "Feb 19 24:00:00 h p: m", "Feb 30 10:00:00 h p: m", "Fub 19 10:00:00 h p: m",
             "anF 19 10:00:00 h p: m", "Feb 19 10:00:0x h p: m", "Feb 19 10:00:00.5 h p: m", "Feb 5  10:00:00 h p: m"]
    assert parse(spark, P.parse_syslog_bsd, lines) == [None] * len(lines)


def test_extended(spark):
    a, b, c, d = parse(
        spark,
        lambda line, y: P.parse_syslog_ext(line),
        [
            "2025 Nov 24 17:56:03.073872 BSL-0101 NOTICE restapi#root: message repeated 47 times",
            "2025 Jan 15 10:30:00.000000 host WARNING dockerd[871]: oom kill",
            "2025 Jan  5 10:30:00 host STRANGE a#b[1]: two\nlines",
            "2025 Jan 15 10:30:00.123 h INFO",
        ],
    )
    assert (a.container, a.process_name, a.level, a.hostname) == ("restapi", "root", "NOTICE", "BSL-0101")
    assert a.timestamp == utc(2025, 11, 24, 17, 56, 3, 73872)
    assert (b.level, b.pid, b.container) == ("WARN", 871, None)
    assert (c.level, c.message, c.timestamp) == (None, "two\nlines", utc(2025, 1, 5, 10, 30))
    assert d is None


def test_iso_and_precise(spark):
    lines = [
        "2026-02-15T17:00:00.000000+09:00 host proc[1]: msg",
        "2026-02-15T08:00:00Z host proc: msg",
        "2026-02-15T08:00:00.1234567-0130 host proc: msg",
        "2026-02-15T08:00:00 host proc: msg",
        "2026-02-15 08:00:00 host proc: msg",
    ]
    a, b, c, d, e = parse(spark, lambda line, y: P.parse_syslog_iso(line), lines)
    assert a.timestamp == utc(2026, 2, 15, 8) and a.pid == 1
    assert b.timestamp == utc(2026, 2, 15, 8)
    assert c.timestamp == utc(2026, 2, 15, 9, 30, 0, 123456)
    assert d.timestamp == utc(2026, 2, 15, 8) and e is None
    lines = [
        "2026-03-03 06:54:06.123456-08:00 hostname process[7]: msg",
        "2026-03-03 06:54:06 2026-03-01T00:00:39.241739-08:00 hostname proc: second",
        "2026-03-03 06:54:06 hostname proc: plain",
    ]
    a, b, c = parse(spark, lambda line, y: P.parse_syslog_iso(line, precise=True), lines)
    assert a.timestamp == utc(2026, 3, 3, 14, 54, 6, 123456) and a.pid == 7
    assert b.timestamp == utc(2026, 3, 1, 8, 0, 39, 241739) and b.message == "second"
    assert c.timestamp == utc(2026, 3, 3, 6, 54, 6) and c.hostname == "hostname"


def test_table_log(spark):
    got = parse(
        spark,
        lambda line, y: P.parse_table_log(line),
        [
            "2025-11-13.22:19:35.523199|PORT_TABLE:Ethernet248|SET|admin_status:up|alias:etp31|index:31",
            "2025-11-13.22:19:38.096435|FLEX_COUNTER_TABLE|PG_DROP|SET|FLEX_COUNTER_STATUS:enable",
            "2025-11-13.22:23:57.885443|ROUTE_TABLE:fd00::/80|DEL",
            "2025-11-13.22:19:03.248563|recording started",
            "2025-11-13.22:19:03.248563|T|DEL",
            "2025-11-13.22:19:03.248563|T|HSET|a:b|c",
            "2025-11-13.22:19:03.248563|T|other",
            "2025-11-13.22:19:03.248563|",
            "2025-11-13 22:19:03.248563|x",
        ],
    )
    show = lambda r: r and (r.component_name, r.context, r.function, r.message)
    assert [show(r) for r in got] == [
        ("PORT_TABLE", "Ethernet248", "SET", "admin_status:up|alias:etp31|index:31"),
        ("FLEX_COUNTER_TABLE", "PG_DROP", "SET", "FLEX_COUNTER_STATUS:enable"),
        ("ROUTE_TABLE", "fd00::/80", "DEL", ""),
        (None, None, None, "recording started"),
        ("T", None, "DEL", ""),
        ("T", None, "HSET", "a:b|c"),
        (None, None, None, "T|other"),
        (None, None, None, ""),
        None,
    ]


T0 = "2025-05-18.06:38:35.610696|"


def test_op_log(spark):
    got = parse(
        spark,
        lambda line, y: P.parse_op_log(line),
        [
            T0 + "c|TYPE_HOSTIF:oid:0xd0|A=B|C=D",
            T0 + "r|TYPE_VLAN:oid:0x27",
            T0 + 'r|TYPE_ROUTE:{"dest":"a|b"}',
            T0 + "C|TYPE_ROUTE||x|A=1||y|A=2",
            T0 + "C|no double pipe",
            T0 + "q|avail|TYPE_SWITCH:oid:0x21|N=1",
            T0 + "q|avail|word|N=1",
            T0 + "q|avail|word",
            T0 + "q|avail",
            T0 + "Q|avail|STATUS|N=2",
            T0 + 'n|port_state|[{"a":1}]|',
            T0 + "a|INIT_VIEW",
            T0 + "A|STATUS_OK",
            T0 + "x|some random",
            T0 + "s|:odd|v",
            T0 + "ab|c",
        ],
    )
    show = lambda r: r and (r.function, r.component_name, r.context, r.message)
    assert [show(r) for r in got] == [
        ("Create", "TYPE_HOSTIF", "oid:0xd0", "A=B|C=D"),
        ("Remove", "TYPE_VLAN", "oid:0x27", ""),
        ("Remove", "TYPE_ROUTE", '{"dest":"a|b"}', ""),
        ("BulkCreate", "TYPE_ROUTE", None, "||x|A=1||y|A=2"),
        ("BulkCreate", None, None, "no double pipe"),
        ("Query: avail", "TYPE_SWITCH", "oid:0x21", "N=1"),
        ("Query: avail", "word", "word", "N=1"),
        ("Query: avail", "word", None, ""),
        ("Query: avail", None, None, ""),
        ("QueryResponse: avail", None, None, "STATUS|N=2"),
        ("Notification: port_state", None, None, '[{"a":1}]'),
        ("NotifySyncd", None, "INIT_VIEW", "INIT_VIEW"),
        ("NotifySyncdResponse", None, None, "STATUS_OK"),
        ("x", None, None, "some random"),
        ("Set", ":odd", None, "v"),
        None,
    ]
    assert got[10].level == "NOTICE" and got[0].level == "INFO"


def test_response_expansion(spark):
    lines = [T0 + "g|TYPE_PORT:oid:0x1|SPEED=0", T0 + "G|CODE=STATUS_OK|SPEED=100|bare", T0 + "a|APPLY", T0 + "A|DONE"]
    df = spark.createDataFrame([("s", 0, i, x) for i, x in enumerate(lines)], "source string, block_start long, seq long, line string")
    rows = parse_chain(df, [P.OP_PARSER], year=None).select("source", "block_start", "seq", "parser", "parsed.*")
    out = expand_attributes(carry_request_context(rows)).orderBy("seq").collect()
    assert (out[1].context, out[1].component_name) == ("oid:0x1", "TYPE_PORT")
    assert [(e.path, e.value) for e in out[1].expanded] == [
        ("Operation", "GetResponse"), ("Object Type", "TYPE_PORT"), ("OID", "oid:0x1"), ("Status", "STATUS_OK"),
        ("Attributes.SPEED", "100"), ("Attributes.bare", ""), ("Request Context", "oid:0x1"),
    ]
    assert [(e.path, e.value) for e in out[3].expanded] == [
        ("Operation", "NotifySyncdResponse"), ("OID", "APPLY"), ("Status", "DONE")
    ]


def test_json(spark):
    a, b, c, d, e, f, g = parse(
        spark,
        lambda line, y: parse_json_log(line),
        [
            '{"ts":"2026-01-15T10:30:00Z","severity":"ERROR","msg":"fail","host":"web01","service":"api","pid":1234,"tid":"5678"}',
            '{"timestamp":1737000000,"message":"s"}',
            '{"timestamp":1737000000000,"message":7}',
            '{"message":"hi","custom_field":"value","count":42,"none":null,"level":3}',
            '{"a":1} trailing',
            "plain text",
            '  {"msg":"low","message":"high","MSG":"upper","pid":"x"} ',
        ],
    )
    assert (a.level, a.message, a.hostname, a.component_name, a.pid, a.tid) == ("ERROR", "fail", "web01", "api", 1234, 5678)
    assert a.timestamp == utc(2026, 1, 15, 10, 30) and a.metadata is None and a.expanded is None
    assert b.timestamp == c.timestamp and c.message == "7"
    assert d.metadata == {"custom_field": "value", "count": "42", "none": "null"} and d.level is None
    assert [x.path for x in d.expanded] == ["Payload.count", "Payload.custom_field", "Payload.level", "Payload.none"]
    assert e is None and f is None
    assert g.message == "low" and g.pid is None


def test_json_tree(spark):
    deep = '{"k":' * 13 + "1" + "}" * 13
    rows = [(0, '{"message":"t","data":{"items":[1,2,{"z":null}],"flag":true,"no":{}}}'), (1, deep)]
    df = spark.createDataFrame(rows, "i int, line string")
    flat, cut = [r.e for r in df.select("i", expand_json(F.col("line")).alias("e")).orderBy("i").collect()]
    assert [(x.path, x.label, x.value) for x in flat] == [
        ("Payload.data.flag", "flag", "true"),
        ("Payload.data.items[0]", "[0]", "1"),
        ("Payload.data.items[1]", "[1]", "2"),
        ("Payload.data.items[2].z", "z", "null"),
    ]
    assert [(x.path, x.value) for x in cut] == [("Payload" + ".k" * 12, "...")]


def test_custom_regex(spark):
    pattern = r"^(?P<timestamp>\S+ \S+) (?P<req_id>\w*)(?: pid=(?P<pid>\d+))? (?P<component>\w+): (?P<message>.*)$"
    a, b, c = parse(
        spark,
        lambda line, y: P.parse_regex(line, pattern),
        ["2024-01-15 10:00:00 r1 pid=7 db: hello", "2024-01-15 10:00:00  db: x\u0001y", "nothing"],
    )
    assert (a.pid, a.component_name, a.message, a.metadata) == (7, "db", "hello", {"req_id": "r1"})
    assert (b.pid, b.message, b.metadata) == (None, "x\u0001y", {"req_id": ""})
    assert c is None


def test_regex_dialect(spark):
    assert translate(r"(?P<obj_type>\w+)$").names == ("obj_type",)
    with pytest.raises(ValueError):
        translate("(unclosed")
    df = spark.createDataFrame([("café\n",), ("end",)], "x string")
    got = [tuple(r) for r in df.select(search(F.col("x"), r"^\w{4}$"), search(F.col("x"), "END$", True)).collect()]
    assert got == [(False, False), (False, True)]


def test_regex_classes_codes_and_repetitions(spark):
    cases = [
        (r"\A[a-z--[aeiou]]+\z", {"xyz": True, "aaa": False, "x-": False, "xay": False}),
        (r"\A[\w--\d]+$", {"ab_": True, "ab1": False, "é": True}),
        (r"\A[^\w--\d]\z", {"1": True, "a": False, "-": True}),
        (r"\A[a-f&&d-z]+\z", {"def": True, "c": False, "g": False}),
        (r"\A[a-d~~c-f]+\z", {"abef": True, "c": False}),
        (r"\A[a-z--b--c]+\z", {"ad": True, "b": False, "c": False}),
        (r"\A[[:alpha:]--[x-z]]\z", {"a": True, "x": False, "1": False}),
        (r"\A[-a]+\z", {"a-": True, "b": False}),
        (r"\A[]a]+\z", {"]a": True, "b": False}),
        (r"\A[^]a]\z", {"]": False, "b": True}),
        (r"\u{41}\x{42}\u0043\U00000044\x45", {"ABCDE": True, "A": False}),
        (r"[\u{e9}]", {"é": True, "e": False}),
        (r"a++a", {"aaa": True, "a": False}),
        (r"\A(?:a|b)+*c{2}{2}\z", {"abcccc": True, "cccc": True, "ccc": False}),
        (r"\A[ab]{2}+\z", {"abab": True, "aba": False}),
        (r"\A(x)(?i:y)??z\z", {"xYz": True, "xz": True, "XYz": False}),
        (r"a\vb", {"a\x0bb": True, "a\nb": False}),
        (r"\{a\}", {"{a}": True}),
    ]
    df = spark.createDataFrame([(t,) for t in sorted({t for _, want in cases for t in want})], "x string")
    found = {r.x: r for r in df.select("x", *[search(F.col("x"), p).alias(f"c{i}") for i, (p, _) in enumerate(cases)]).collect()}
    got = [(p, {t: found[t][f"c{i}"] for t in want}) for i, (p, want) in enumerate(cases)]
    assert got == cases
    made = translate(r"(?P<a.b>x)?(?P<c>y+)|(?<d>[(]z)")
    assert made.names == ("a.b", "c", "d") and made.numbers == (1, 2, 3) and made.optional == {"a.b", "c", "d"}
    assert translate(r"(?:(?P<a>x)+)*(?P<b>\((y)\))").optional == {"a"}


@pytest.mark.parametrize("pattern", ["(?=x)", "(?!x)", "(?<=x)y", "(?<!x)y", "(?>x)", r"(a)\1", r"(?P<n>a)\k<n>", "(?P<n>a)(?P=n)", r"a\Z", "[a", "[a--", "+a", "a\\"])
def test_regex_forms_that_are_refused(pattern):
    with pytest.raises(ValueError):
        translate(pattern)


def test_detection(spark):
    lines = {
        "syslog": ["Feb 19 14:23:45 h p: m", "", "Feb 19 14:23:46 h p: m", "junk"],
        "generic": ["2026-06-24T10:00:01Z INFO msg"] * 3,
        "json": ['{"a":1}', ' {"b":2} ', "x"],
        "op_log": [T0 + "c|A:b|x"] * 2,
        "table_log": [T0 + "A:b|SET|x:y"] * 2,
    }
    rows = [(s, s, 0, i, x, 2024) for s, xs in lines.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "loader_id string, source string, block_start long, seq long, line string, mod_year int")
    assert {r.source: r.format for r in detect_formats(df).collect()} == {s: s for s in lines}


def test_otlp(spark):
    doc = (
        '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"1700000000000000000","severityText":"INFO",'
        '"body":{"stringValue":"one"}},{"severityText":"WARN"},{"body":{}}]}]}]}'
    )
    df = spark.createDataFrame([(doc,), ("not json",)], "value string")
    assert [r.line for r in otlp_records(df).orderBy("record_no").collect()] == ["1700000000000000000 INFO one", "WARN"]


def test_durations(spark):
    texts = ["5m", "30s", "2h", "1h30m", "500ms", "", "5", "m5", "0s", "5x", "99999999999999999999s", "1d 2h"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(parse_duration(F.col("t"))).collect()]
    assert got == [300_000, 30_000, 7_200_000, 5_400_000, 500] + [None] * 7
    assert duration_ms("1h30m") == 5_400_000 and timeout_seconds("2m") == 120
    ms = spark.createDataFrame([(-5,), (250,), (1500,), (125_000,)], "m long")
    assert [r[0] for r in ms.select(fmt_duration(F.col("m"))).collect()] == ["0ms", "250ms", "1.5s", "2m5s"]


def test_posix_classes_and_flags(spark):
    cases = [
        (r"[[:alpha:]]+x", "abcx", True), (r"^[[:alpha:]]$", ":", False), (r"[^[:space:][:digit:]]", "1 2", False), (r"^[[:^alpha:]]+$", "12", True),
        (r"\x{41}b", "Ab", True), (r"(?im)^foo$", "a\nFOO\nb", True), (r"^foo$", "a\nfoo\nb", False), (r"(?m:^a$)", "b\na\nc", True),
        (r"(?m:^a$)\nb$", "a\nb\n", False), (r"(?m)(?-m)a$", "a\nb", False),
    ]
    for pattern, text, want in cases:
        assert spark.range(1).select(search(F.lit(text), pattern)).first()[0] is want, pattern
    for bad in ("(?U)a+", "[[:nope:]]"):
        with pytest.raises(ValueError):
            translate(bad)


def test_json_number_text(spark):
    texts = {
        "1": "1", "1.0": "1.0", "1.50": "1.5", "1e3": "1000.0", "100000000000000000000": "1e20", "18446744073709551615": "18446744073709551615",
        "0.00001": "0.00001", "1e-6": "1e-6", "1.5e16": "1.5e16", "1e15": "1000000000000000.0", '{"f":2.0,"b":[1.0,3]}': '{"b":[1.0,3],"f":2.0}',
    }
    lines = [(k, f'{{"message":"m","x":{k}}}') for k in texts]
    rows = spark.createDataFrame(lines, "k string, line string").select("k", parse_json_log(F.col("line")).alias("r"))
    assert {r.k: r.r.metadata["x"] for r in rows.collect()} == texts
