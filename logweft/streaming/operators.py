"""Filters, counts and densities on streams of logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.durations import duration_ms
from ..operators.categories import category_tags
from ..operators.filters import stack_condition
from ..operators.search import search_condition
from ..plans.segments import FENCE_SCHEMA, Store, fences_of, merge_late, with_first, write_sorted
from ..session import materialize
from .batches import all_batches, batch_path, delete, last_batch, state_before, write_batch, write_state


def stream_filter(sdf: DataFrame, entries: list[tuple[object, bool]]) -> DataFrame:
    """Only new rows are tested."""
    return sdf.filter(stack_condition(entries))


def stream_search(sdf: DataFrame, pattern: str) -> DataFrame:
    return sdf.filter(search_condition(pattern))


def stream_level_counts(sdf: DataFrame) -> DataFrame:
    """Running count per level (output mode complete or update)."""
    return sdf.groupBy("level").agg(F.count("*").alias("records"))


def stream_categories(sdf: DataFrame, rules: list[tuple[str, object]], width: str | None = None) -> DataFrame:
    """Running count per category, and per time slice of ``width`` (a fixed grid) when given."""
    tagged = category_tags(sdf, rules).withColumn("category", F.explode("categories"))
    if width is None:
        return tagged.groupBy("category").agg(F.count("*").alias("records"))
    counts = tagged.groupBy("category", F.window("timestamp", width).alias("w")).agg(F.count("*").alias("records"))
    return counts.select("category", F.col("w.start").alias("slice_start"), "records")


def with_lateness(sdf: DataFrame, delay: str) -> DataFrame:
    """Accept rows up to ``delay`` late; later ones are lost to windows that closed. ``keep_late`` loses nothing."""
    return sdf.withWatermark("timestamp", delay)


def keep_late(sdf: DataFrame, delay: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Store all rows; those more than ``delay`` older than the newest of earlier batches are flagged ``late``.

    Late rows make small tables of their own, so that what was stored in time order stays as it is;
    ``merged`` reads both.
    """
    newest = f"{checkpoint}/newest"
    micros = duration_ms(delay) * 1000

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = state_before(session, newest, batch_id, "newest bigint").agg(F.max("newest")).first()[0]
        at = F.unix_micros("timestamp")
        late = F.lit(False) if before is None else F.coalesce(at < before - micros, F.lit(False))
        flagged = materialize(batch.withColumn("late", late), "late")
        write_batch(flagged.filter(~F.col("late")).drop("late"), f"{out}/on-time", batch_id)
        write_batch(flagged.filter("late").drop("late"), f"{out}/late", batch_id)
        high = flagged.agg(F.greatest(F.max(F.unix_micros("timestamp")), F.lit(before).cast("bigint")).alias("newest"))
        write_state(high.coalesce(1), newest, batch_id)

    writer = sdf.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{checkpoint}/query")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def merged(spark: SparkSession, out: str, schema) -> DataFrame:
    """All rows of ``keep_late`` with ``late``; sort by time or number them (``with_record_index``) for positions."""
    parts = [all_batches(spark, f"{out}/{name}", schema).withColumn("late", F.lit(name == "late")) for name in ("on-time", "late")]
    return parts[0].unionByName(parts[1])


#: Late rows that wait before they are merged into the files they belong to.
MERGE_AT = 100_000


def keep_sorted(
    sdf: DataFrame, out: str, checkpoint: str, order: Sequence[str], threshold: int = MERGE_AT, trigger: dict | None = None
) -> StreamingQuery:
    """Store a stream in time order: as sorted files with fences (``plans/segments.py``), whose ranges of time do not overlap.

    A row at or after the newest stored time goes into new files. An older one is late and waits in a side table; once
    ``threshold`` rows wait, they are merged, and only files into whose range they fall are written anew. ``sorted_store``
    and ``waiting_rows`` read the two; files given up by a merge are deleted two batches later, when no repeated
    batch can ask for them. Rows without a time count as on time. ``order``: the time, then what tells equal times apart.
    """
    fences, waiting, time = f"{checkpoint}/fences", f"{checkpoint}/waiting", order[0]
    schema = sdf.schema

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = state_before(session, fences, batch_id, FENCE_SCHEMA)
        newest = known.agg(F.max("hi")).first()[0]
        late = F.lit(False) if newest is None else F.coalesce(F.col(time) < F.lit(newest), F.lit(False))
        flagged = materialize(batch.withColumn("__late", late), "arrived")
        on_time = flagged.filter(~F.col("__late")).drop("__late")
        store = Store(known, schema, time)
        if not on_time.isEmpty():
            path = batch_path(f"{out}/on-time", batch_id)
            write_sorted(on_time, path, order)
            store = Store(with_first(known.drop("first").unionByName(fences_of(session, path, schema, time))), schema, time)
        rows = state_before(session, waiting, batch_id, schema).unionByName(flagged.filter("__late").drop("__late"))
        rows = materialize(rows, "waiting")
        if rows.count() >= threshold:
            store = merge_late(store, rows, order, batch_path(f"{out}/merged", batch_id))
            rows = rows.limit(0)
        write_state(rows, waiting, batch_id)
        if batch_id >= 2:
            _delete_given_up(session, fences, batch_id)
        write_state(store.fences.coalesce(1), fences, batch_id)

    writer = sdf.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{checkpoint}/query")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _delete_given_up(session: SparkSession, fences: str, batch_id: int) -> None:
    """Files that the batch before the last one still had and the last one has not: as many as one merge touched."""
    before, after = (session.read.schema(FENCE_SCHEMA).parquet(batch_path(fences, batch_id - k)) for k in (2, 1))
    for row in before.join(after, "file", "left_anti").select("file").collect():
        delete(session, row["file"])


def sorted_store(spark: SparkSession, checkpoint: str, schema, time: str = "timestamp") -> Store:
    """The files of ``keep_sorted`` after its last batch."""
    return Store(last_batch(spark, f"{checkpoint}/fences", FENCE_SCHEMA), schema, time)


def waiting_rows(spark: SparkSession, checkpoint: str, schema) -> DataFrame:
    """Late rows that no merge has taken yet."""
    return last_batch(spark, f"{checkpoint}/waiting", schema)


def stream_density(sdf: DataFrame, width: str, by: str | None = None) -> DataFrame:
    """Counts per time slice (and per level or another column)."""
    keys = [by] if by else []
    counts = sdf.groupBy(*keys, F.window("timestamp", width).alias("w")).agg(F.count("*").alias("records"))
    return counts.select(*keys, F.col("w.start").alias("slice_start"), "records")
