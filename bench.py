"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` choose data and
threads. The best of three runs counts; what a query starts from (line files, the
log table with positions) is made before the clock starts, except where making
it is the query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from logweft import get_spark, materialize  # noqa: E402
from logweft.catalog import common as cm  # noqa: E402
from logweft.catalog.spans import visit_rules  # noqa: E402
from logweft.operators import aggregates as ag  # noqa: E402
from logweft.operators import ordering as od  # noqa: E402
from logweft.operators import region_lookup as rl  # noqa: E402
from logweft.operators import regions as rg  # noqa: E402
from logweft.operators import search as se  # noqa: E402
from logweft.operators import sinks as si  # noqa: E402
from logweft.operators.chain import parse_chain, parse_lines, to_logs  # noqa: E402
from logweft.operators.filters import filter_set  # noqa: E402
from logweft.operators.parsers import regex_parser  # noqa: E402
from logweft.plans.pipe import pipe  # noqa: E402
from logweft.sources.text import read_lines  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(run, times: int = 3) -> float:
    took = []
    for _ in range(times):
        t0 = time.perf_counter()
        run()
        took.append(time.perf_counter() - t0)
    return round(min(took), 3)


def line_files(spark) -> tuple[str, int]:
    """Syslog lines of all line items: the largest table."""
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    levels = F.array(*[F.lit(x) for x in ("DEBUG", "INFO", "NOTICE", "WARNING", "ERROR")])
    line = F.concat(
        F.date_format("l_shipdate", "yyyy MMM dd HH:mm:ss"), F.lit("."), F.lpad((F.col("l_orderkey") % 1_000_000).cast("string"), 6, "0"),
        F.lit(" host"), (F.col("l_suppkey") % 50).cast("string"), F.lit(" "),
        F.element_at(levels, (F.col("l_linenumber") % 5 + 1).cast("int")), F.lit(" web#app["), F.col("l_partkey").cast("string"),
        F.lit("]: order "), F.col("l_orderkey").cast("string"), F.lit(" price "), F.col("l_extendedprice").cast("string"),
    )
    path = cm.fresh_dir(spark, "bench-lines")
    items.select(line).repartition(16).write.text(path)
    return path, items.count()


def layout_files(spark) -> dict[str, str]:
    """The same line items as table-log, op-log, JSON and custom lines, for the parsers of those layouts."""
    items = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    text = lambda c: F.col(c).cast("string")
    dotted = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd.HH:mm:ss"), F.lit("."), F.lpad((F.col("l_orderkey") % 1_000_000).cast("string"), 6, "0"))
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = {
        "table_log": F.concat(dotted, F.lit("|ORDER_TABLE:"), text("l_orderkey"), F.lit("|SET|part:"), text("l_partkey"), F.lit("|price:"), text("l_extendedprice")),
        "op_log": F.concat(dotted, F.lit("|c|ORDER:oid:0x"), text("l_orderkey"), F.lit("|PART="), text("l_partkey"), F.lit("|PRICE="), text("l_extendedprice")),
        "json": F.to_json(
            F.struct(
                stamp.alias("ts"), F.lit("INFO").alias("level"), F.concat(F.lit("order "), text("l_orderkey")).alias("msg"),
                F.lit("web01").alias("host"), F.col("l_partkey").alias("pid"), F.col("l_extendedprice").alias("price"),
            )
        ),
        "custom": F.concat(stamp, F.lit(" <INFO> web["), text("l_partkey"), F.lit("] order "), text("l_orderkey")),
    }
    paths = {}
    for name, line in lines.items():
        paths[name] = cm.fresh_dir(spark, f"bench-{name}")
        items.select(line).repartition(16).write.text(paths[name])
    return paths


CUSTOM = r"^(?P<timestamp>\S+) <(?P<level>\w+)> (?P<process>\w+)\[(?P<pid>\d+)\] (?P<message>.*)$"


def main() -> None:
    spark = get_spark(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__driver__memory="20g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    path, n_lines = line_files(spark)
    logs = cm.logs(spark, SF_DIR)
    store = materialize(od.with_record_index(logs), "bench-store")
    found = materialize(rg.regions(store, visit_rules()), "bench-regions")
    glob = f"{path}/part-*"
    keep = [{"field": "message", "op": "contains", "value": "price 1"}]

    def out(label: str) -> str:
        return cm.fresh_dir(spark, label)

    runs = {
        "p3_parse_syslog": lambda: consume(to_logs(parse_lines(read_lines(spark, path), "syslog"))),
        "k6_pipe_json": lambda: pipe(spark, glob, keep, level="NOTICE", fmt="json", out=out("pipe"), formats="syslog"),
        "a1_count_parsed": lambda: ag.count_by_level(to_logs(parse_lines(read_lines(spark, path), "syslog"))).collect(),
        "r2_record_index": lambda: consume(od.with_record_index(logs)),
        "f14_filter_set": lambda: consume(filter_set(logs, ["level = 'ERROR'"], ["pid < 10"])),
        "q1_search": lambda: consume(se.search(store, r"value=\d*7\b")),
        "a1_count_by_level": lambda: ag.count_by_level(store).collect(),
        "a3_level_distribution": lambda: ag.level_distribution(store).collect(),
        "a6_density": lambda: ag.density(store, 200).collect(),
        "g3_regions": lambda: consume(rg.regions(store, visit_rules())),
        "g9_innermost_region": lambda: consume(rl.innermost_region(store, found)),
        "r8_jump_relative": lambda: consume(od.jump_relative(store, store, "5m")),
        "k3_write_csv": lambda: si.write_csv(store, out("csv")),
    }
    took = {name: best(run) for name, run in runs.items()}
    other = layout_files(spark)
    parse = lambda name, fmt: consume(to_logs(parse_lines(read_lines(spark, other[name]), fmt)))
    custom = lambda: consume(to_logs(parse_chain(read_lines(spark, other["custom"]), [regex_parser("custom", CUSTOM)])))
    took |= {
        "p6_parse_table_log": best(lambda: parse("table_log", "table_log"), 2),
        "p7_parse_op_log": best(lambda: parse("op_log", "op_log"), 2),
        "p10_parse_json": best(lambda: parse("json", "json"), 1),
        "p12_parse_regex": best(custom, 2),
    }
    parsed = ("p3_parse_syslog", "k6_pipe_json", "a1_count_parsed", "p6_parse_table_log", "p7_parse_op_log", "p10_parse_json", "p12_parse_regex")
    rate = {name: round(n_lines / took[name]) for name in parsed}
    print(
        json.dumps(
            {
                "metric": "headline log queries, best of three",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "lines": n_lines,
                "lines_per_sec": rate,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
