"""Session set-up and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Generated methods beyond this many bytecodes are never compiled by the JVM, only
# interpreted; parsing then runs several times slower than without fusing the stage.
METHOD_LIMIT = "8000"


# The payload tree of JSON lines nests deeper than the analyzer's usual number of passes.
ANALYZER_PASSES = "300"


CALL_SITES = "spark.python.sql.dataFrameDebugging.enabled"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on, for a session made elsewhere; they stay set in that session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.analyzer.maxIterations", ANALYZER_PASSES)
    _without_call_sites(spark)
    return spark


def _without_call_sites(spark: SparkSession) -> None:
    """Building a Column otherwise inspects the Python stack every time, seconds for a parse chain."""
    try:
        spark.conf.set(CALL_SITES, "false")
    except Exception:  # a setting that this Spark does not let a running session change
        pass


def get_spark(app: str = "logweft", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on (UTC, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.analyzer.maxIterations": ANALYZER_PASSES,
        "spark.sql.codegen.hugeMethodLimit": METHOD_LIMIT,
        CALL_SITES: "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may go without that setting; it then gets a fresh
    temporary folder, which no other machine has to see.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="logweft-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/logweft/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and, unlike a
    cached or checkpointed RDD, later readers still prune columns and rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle. Small files may hold many rows, and rows made from them by
    ``explode`` do not count in Spark's estimate, so either side could else be collected on the driver."""
    return df.hint("merge")
