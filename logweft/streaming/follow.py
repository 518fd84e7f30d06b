"""Growing inputs: pick up new files, parse them, continue the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chain import carry_request_context, expand_attributes, format_parsers, parse_chain, to_logs
from ..operators.ordering import assign_ids
from ..schema import LOG_SCHEMA
from ..session import scratch_path
from ..sources.text import strip_cr
from .batches import all_batches, state_before, write_batch, write_state
from .growing import growing_lines, grown_from, snapshot

_LOW33 = (1 << 33) - 1


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New lines of a folder; a file counts once it is there as a whole. Empty lines are skipped,
    lines of blanks are not.

    Files that disappear are no error: what they gave stays.
    """
    text = spark.readStream.options(lineSep="\n", ignoreMissingFiles="true", **options).text(path)
    meta = F.col("_metadata")
    return text.select(
        meta["file_path"].alias("loader_id"),
        meta["file_path"].alias("source"),
        meta["file_block_start"].alias("block_start"),
        strip_cr(F.col("value")).alias("line"),
        F.year(meta["file_modification_time"]).alias("mod_year"),
    ).filter(F.col("line") != "")


def stream_logs(spark: SparkSession, path: str, fmt: str, ingest_ts=None, **options: str) -> DataFrame:
    """Parsed records of new lines (stateless: no ids). ``fmt`` is fixed at the start, from ``detect_formats``."""
    rows = parse_chain(stream_lines(spark, path, **options), format_parsers(fmt))
    return to_logs(rows, ingest_ts).drop("block_start", "parser")


# Take what is there and end. ``{"processingTime": "10 seconds"}`` keeps a stream running.
ONCE = {"availableNow": True}


def follow(
    spark: SparkSession, path: str, fmt: str, out: str, checkpoint: str, ingest_ts=None, trigger: dict = ONCE, growing: bool = False,
    **options: str,
) -> StreamingQuery:
    """Append parsed records with continuing ids to ``out``; read them with ``followed``.

    ``trigger`` is that of ``writeStream``; other options go to the reader. Files count once they are there as a whole, or
    with ``growing`` line by line as they are written (``growing_lines``).
    """
    counts = f"{checkpoint}/ids"
    if growing:
        arriving = growing_lines(spark, path, **options)
    else:
        seq = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))
        arriving = stream_lines(spark, path, **options)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        lines = batch if growing else batch.withColumn("seq", seq)
        logs = to_logs(parse_chain(lines, format_parsers(fmt)), ingest_ts)
        if fmt == "op_log":
            logs = carry_request_context(logs)
        numbered = assign_ids(expand_attributes(logs).drop("parser")).drop("block_start", "seq")
        first = state_before(session, counts, batch_id, "next_id bigint").agg(
            F.coalesce(F.max("next_id"), F.lit(0))
        ).scalar()
        write_batch(numbered.withColumn("id", F.col("id") + first), out, batch_id)
        done = session.read.parquet(f"{out}/batch={batch_id:012d}")
        write_state(done.agg((F.count("*") + first).alias("next_id")).coalesce(1), counts, batch_id)

    return (
        arriving.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{checkpoint}/query")
        .trigger(**trigger)
        .start()
    )


def followed(spark: SparkSession, out: str) -> DataFrame:
    return all_batches(spark, out, LOG_SCHEMA)


def restart(spark: SparkSession, path: str, fmt: str, **kw) -> tuple[StreamingQuery, str]:
    """Reprocess a replaced source from scratch: a new run with its own state, ids from 0."""
    base = scratch_path(spark, "follow")
    out = f"{base}/out"
    return follow(spark, path, fmt, out, f"{base}/checkpoint", **kw), out


SOURCE_SCHEMA = "path string, bytes bigint, head string, tail string"


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """How far each file below ``path`` can be read now, with digests of its beginning and of the bytes before that end."""
    rows = [(name, x["bytes"], x["head"], x["tail"]) for name, x in snapshot(path).items()]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def replaced(now: DataFrame, known: DataFrame) -> bool:
    """Whether a file that was read before has other content now.

    A file that is gone was rotated away; one that only got longer has grown.
    """
    old = known.select("path", *[F.col(c).alias(f"__{c}") for c in ("bytes", "head", "tail")])

    @F.udf("boolean")
    def same(path, bytes_now, head_now, tail_now, bytes_old, head_old, tail_old):
        before, after = ({"bytes": b, "head": h, "tail": t} for b, h, t in ((bytes_old, head_old, tail_old), (bytes_now, head_now, tail_now)))
        return grown_from(path, before, after)

    both = now.join(old, "path")
    return not both.filter(~same("path", "bytes", "head", "tail", "__bytes", "__head", "__tail")).isEmpty()


def follow_current(spark: SparkSession, path: str, fmt: str, base: str, **kw) -> tuple[StreamingQuery, str]:
    """Go on following ``path``, whose files may grow, or start over if a file already read was replaced.

    Each start over has its own folder below ``base`` (``run=0``, ``run=1``, ...); the returned folder
    holds the records of the current run, with ids from 0.
    """
    runs = f"{base}/sources"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(runs)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    run, now = 0, source_files(spark, path).persist()
    if fs.exists(hadoop):
        run = max(int(s.getPath().getName().removeprefix("run=")) for s in fs.listStatus(hadoop))
        run += replaced(now, spark.read.schema(SOURCE_SCHEMA).parquet(f"{runs}/run={run}"))
    now.coalesce(1).write.mode("overwrite").parquet(f"{runs}/run={run}")
    out = f"{base}/run={run}/out"
    return follow(spark, path, fmt, out, f"{base}/run={run}/checkpoint", growing=True, **kw), out
