"""Regions on a stream: waiting starts survive between micro-batches.

Every batch pairs its own events together with the starts still waiting, using
the batch operator, so one busy key is spread over tasks here as well. Batches
are taken in arrival order; inside a batch records are put in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import time_key, with_record_index
from ..operators.regions import START, listed_points, pair_regions, point_items, render_regions
from ..rules import RegionRule
from ..session import materialize
from .batches import all_batches, state_before, write_batch, write_state
from .follow import ONCE

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())
WAITING = T.StructType(
    [
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("point", T.IntegerType()),
        T.StructField("idx", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("metadata", _TEXT_MAP),
    ]
)
REGION_SCHEMA = T.StructType(
    [
        T.StructField("definition_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("start_reason", T.StringType()),
        T.StructField("end_reason", T.StringType()),
        T.StructField("start_index", T.LongType()),
        T.StructField("end_index", T.LongType()),
        T.StructField("metadata", _TEXT_MAP),
        T.StructField("timed_out", T.BooleanType()),
        T.StructField("rule_ord", T.IntegerType()),
        T.StructField("close_index", T.LongType()),
        T.StructField("start_ts", T.TimestampType()),
        T.StructField("end_ts", T.TimestampType()),
    ]
)


def stream_regions(
    logs: DataFrame, rules: list[RegionRule], out: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Write finished regions to ``out`` as they close; read them with ``closed_regions``."""
    waiting_dir, index_dir = f"{checkpoint}/waiting", f"{checkpoint}/index"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        first = state_before(session, index_dir, batch_id, "next_index bigint").agg(
            F.coalesce(F.max("next_index"), F.lit(0))
        ).scalar()
        # Positions count all records, but of a record only its time, place and points are moved.
        key = time_key(batch)
        narrow = batch.select(*key, point_items(rules).alias("_items"))
        indexed = with_record_index(narrow).withColumn("record_index", F.col("record_index") + first)
        waiting = state_before(session, waiting_dir, batch_id, WAITING)
        points = listed_points(indexed, F.col("_items")).unionByName(waiting)
        spans = materialize(pair_regions(points, rules), "stream-spans")
        write_batch(render_regions(spans, rules), out, batch_id)
        still_open = spans.filter(F.col("status") == "open").select(
            "rule_ord",
            F.lit(START).alias("kind"),
            F.col("start_point").alias("point"),
            F.col("start_index").alias("idx"),
            F.col("start_ts").alias("ts"),
            F.col("start_metadata").alias("metadata"),
        )
        write_state(still_open, waiting_dir, batch_id)
        write_state(indexed.agg((F.count("*") + first).alias("next_index")).coalesce(1), index_dir, batch_id)

    return (
        logs.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{checkpoint}/query")
        .trigger(**trigger)
        .start()
    )


def closed_regions(spark, out: str) -> DataFrame:
    return all_batches(spark, out, REGION_SCHEMA)
