"""Shared parts of the registered queries: the test tables as logs, and the registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from ..operators.ordering import with_record_index
from ..session import materialize, scratch_path, tune
from ..sources.tables import as_logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its equivalent."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return naive_times(fn(tune(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def naive_times(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, as the tables have them."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


# Read as TIMESTAMP so that time filters reach the scan without a cast.
EVENTS_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", EVENTS_SCHEMA)


def level_of(kind: Column) -> Column:
    return (
        F.when(kind == "error", "ERROR")
        .when(kind == "signup", "NOTICE")
        .when(kind == "purchase", "INFO")
        .when(kind == "click", "DEBUG")
    )


def amount(c: str = "value") -> Column:
    return F.col(c).cast("decimal(12,2)").cast("string")


def message() -> Column:
    return F.concat("event_type", F.lit(" value="), amount())


def to_log_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return as_logs(
        df,
        {
            "id": "event_id",
            "timestamp": "ts",
            "level": level_of(F.col("event_type")),
            "source": F.concat(F.lit("events-"), (F.col("user_id") % 4).cast("string")),
            "pid": "user_id",
            "component_name": "event_type",
            "hostname": F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string")),
            "context": F.when(F.col("event_type") != "view", F.concat(F.lit("u"), F.col("user_id").cast("string"))),
            "message": message(),
            "raw": F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("] "), message()),
            "metadata": F.create_map(F.lit("k"), k),
        },
        keep,
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as logs."""
    return to_log_rows(events(spark, sf_dir))


_STORES: dict[tuple[str, str], DataFrame] = {}


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as logs in time order with positions, written once per session and reused.

    Each file holds a run of positions, so position ranges reach the scan. The events are numbered and
    written as they are and told as logs when read, so that a query pays for the columns it uses.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        named = events(spark, sf_dir).withColumnsRenamed({"event_id": "id", "ts": "timestamp"})
        placed = materialize(with_record_index(named), "store").withColumnsRenamed({"id": "event_id", "timestamp": "ts"})
        _STORES[key] = to_log_rows(placed, ["record_index"])
    return _STORES[key]


# The same tables for the SQL side.
LOGS = """logs AS (
  SELECT event_id AS id, ts AS "timestamp",
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'NOTICE'
                         WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' END AS level,
         CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 3
                         WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 END AS level_rank,
         'events-' || (user_id % 4) AS source, user_id AS pid, event_type AS component_name,
         'host' || (user_id % 20) AS hostname,
         CASE WHEN event_type <> 'view' THEN 'u' || user_id END AS context,
         event_type || ' value=' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS message,
         '[' || event_id || '] ' || event_type || ' value=' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS raw,
         json_extract_string(props, '$.k') AS k
  FROM events)"""
STORE = LOGS + """, store AS (
  SELECT *, row_number() OVER (ORDER BY "timestamp", id) - 1 AS record_index FROM logs)"""


def with_logs(body: str) -> str:
    """SQL over ``logs``; a body that starts with a comma adds more CTEs."""
    return f"WITH {LOGS}{body}" if body.lstrip().startswith(",") else f"WITH {LOGS} {body}"


def with_store(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {', '.join([STORE, *ctes])} {body}"


# ---------------------------------------------------------------- text inputs

DOC_LINES = """doc_lines AS (
  SELECT doc_id, CAST(i AS BIGINT) - 1 AS seq, string_split(text, chr(10))[i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, as ``lines`` with one source per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    source = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")).select(
        source.alias("loader_id"),
        source.alias("source"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("seq").cast("bigint").alias("seq"),
        "line",
        F.lit(2024).alias("mod_year"),
        "doc_id",
    )


def rendered(spark: SparkSession, sf_dir: str, line: Column, source: Column | None = None, where=None) -> DataFrame:
    """Events printed as log lines, in event order, as a ``lines`` table (with ``event_id``)."""
    src = source if source is not None else F.lit("events.log")
    df = events(spark, sf_dir)
    if where is not None:
        df = df.filter(where)
    return df.select(
        src.alias("loader_id"),
        src.alias("source"),
        F.lit(0).cast("bigint").alias("block_start"),
        F.col("event_id").alias("seq"),
        line.alias("line"),
        F.lit(2024).alias("mod_year"),
        "event_id",
    )


def ts_text(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def bsd_line() -> Column:
    return F.concat(
        ts_text("MMM dd HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 20).cast("string"), F.lit(" app["),
        F.col("user_id").cast("string"), F.lit("]: "), message(),
    )


def ext_line() -> Column:
    level = F.coalesce(level_of(F.col("event_type")), F.lit("OTHER"))
    return F.concat(
        ts_text("yyyy MMM dd HH:mm:ss.SSSSSS"), F.lit(" host"), (F.col("user_id") % 20).cast("string"), F.lit(" "),
        level, F.lit(" web#app["), F.col("user_id").cast("string"), F.lit("]: "), message(),
    )


def iso_line(zone: str = "+02:00") -> Column:
    return F.concat(
        ts_text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(zone), F.lit(" host"), (F.col("user_id") % 20).cast("string"),
        F.lit(" "), F.col("event_type"), F.lit(": "), message(),
    )


def table_line() -> Column:
    return F.concat(
        ts_text("yyyy-MM-dd.HH:mm:ss.SSSSSS"), F.lit("|USER_TABLE:u"), F.col("user_id").cast("string"),
        F.when(F.col("event_type") == "error", "|DEL").otherwise("|SET"),
        F.when(F.col("event_type") == "error", "").otherwise(
            F.concat(F.lit("|type:"), F.col("event_type"), F.lit("|value:"), amount())
        ),
    )


def op_line() -> Column:
    """Requests and responses: view asks (g), purchase answers (G), click queries (q), signup answers (Q)."""
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    body = (
        F.when(kind == "view", F.concat(F.lit("g|PORT:oid:0x"), user, F.lit("|SPEED=0")))
        .when(kind == "purchase", F.concat(F.lit("G|STATUS_OK|SPEED="), amount()))
        .when(kind == "click", F.concat(F.lit("q|avail|SWITCH:oid:0x"), user, F.lit("|N=1")))
        .when(kind == "signup", F.concat(F.lit("Q|avail|STATUS=OK|N="), amount()))
        .otherwise(F.concat(F.lit("n|port_state|[{\"u\":"), user, F.lit("}]|")))
    )
    return F.concat(ts_text("yyyy-MM-dd.HH:mm:ss.SSSSSS"), F.lit("|"), body)


def json_log_line() -> Column:
    return F.to_json(
        F.struct(
            ts_text("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
            level_of(F.col("event_type")).alias("severity"),
            message().alias("msg"),
            F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string")).alias("host"),
            F.col("event_type").alias("service"),
            F.col("user_id").alias("pid"),
            F.struct(F.col("event_id").alias("n"), F.col("value").alias("v"), F.round("value").alias("w"), F.array(F.lit("a"), F.col("event_type")).alias("tags")).alias("data"),
        )
    )


def generic_line() -> Column:
    level = F.coalesce(level_of(F.col("event_type")), F.lit("WARNING"))
    return F.concat(ts_text("yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" "), message())


def fresh_dir(spark: SparkSession, label: str) -> str:
    return scratch_path(spark, label)


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")
