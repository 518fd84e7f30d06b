"""Time order, positions and lookups by time or position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.durations import duration_ms
from ..plans.asof import nearest_in_time
from ..plans.scan import Scan, index_chunk, scan
from ..session import materialize

# Arrival order of parsed lines, and of tables that carry an id.
ARRIVAL = ("source_ord", "block_start", "seq")


def _arrival(df: DataFrame) -> list[str]:
    have = [c for c in ARRIVAL if c in df.columns]
    if have:
        return (["source"] if "source_ord" not in have and "source" in df.columns else []) + have
    return ["id"]


def time_key(df: DataFrame) -> list[str]:
    return ["timestamp", *_arrival(df)]


def order_by_time(df: DataFrame) -> DataFrame:
    """All records in time order; equal times keep their arrival order."""
    return df.orderBy(*time_key(df))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Dense positions from 0 in ``order`` (which should be unique).

    One range shuffle, no window: rows are sorted inside range partitions and
    written once with (partition, offset in partition); the start of each
    partition comes from the partition counts, one row per partition.
    """
    packed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    stored = materialize(packed, name)
    part = F.shiftright(F.col("__at"), 33)
    counts = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # At most one row per shuffle partition, so this single window and the broadcast stay small.
    starts = counts.select(
        "__part",
        F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(
            "__start"
        ),
    )
    offset = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        stored.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .select(*df.columns, (F.col("__start") + offset).alias(name))
    )


def with_record_index(df: DataFrame, name: str = "record_index") -> DataFrame:
    """Add the global position in time order."""
    return number_rows(df, time_key(df), name)


def record_at(df: DataFrame, i: int) -> DataFrame:
    return df.filter(F.col("record_index") == i)


def range_by_index(df: DataFrame, start: int, end: int) -> DataFrame:
    """Positions ``[start, end)``; out-of-range bounds simply select less."""
    return df.filter((F.col("record_index") >= start) & (F.col("record_index") < end))


def assign_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """Dense ids in arrival order (source, then line)."""
    base = df.drop(name)
    return number_rows(base, _arrival(base), name)


# A table of file blocks up to this many rows is sent to every task.
BROADCAST_BLOCKS = 200_000


def ids_in_file_order(df: DataFrame, name: str = "id") -> DataFrame:
    """``assign_ids`` for rows that still lie in file order inside their partitions: no shuffle of the rows.

    They are written once with a running number; an id is the start of the
    row's file block (from the counts of the blocks, one row each) plus the
    distance to the block's first row. If the rows of some block do not lie
    together after all, the general way is taken.
    """
    base = df.drop(name)
    block = [c for c in _arrival(base) if c != "seq"]
    stored = materialize(base.withColumn("__at", F.monotonically_increasing_id()), name)
    blocks = materialize(
        stored.groupBy(*block).agg(F.count("*").alias("__n"), F.min("__at").alias("__lo"), F.max("__at").alias("__hi")),
        "blocks",
    )
    check = blocks.agg(
        F.count("*").alias("n"), F.count_if(F.col("__hi") - F.col("__lo") + 1 != F.col("__n")).alias("torn")
    ).first()
    if check["torn"]:
        return number_rows(stored.drop("__at"), _arrival(base), name)
    w = W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(*block, (F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__lo")).alias("__shift"))
    if check["n"] <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    return stored.join(starts, block).select(*base.columns, (F.col("__at") + F.col("__shift")).alias(name))


def find_by_timestamp(df: DataFrame, ts) -> DataFrame:
    """One row: position of the first record at or after ``ts`` (the count if there is none)."""
    return df.agg(F.count_if(F.col("timestamp") < F.lit(ts).cast("timestamp")).alias("record_index"))


def record_count(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("records"), (n == 0).alias("is_empty"))


def flag_out_of_order(df: DataFrame, index: str = "id") -> DataFrame:
    """Add ``out_of_order``: earlier in time than some record that arrived before.

    ``index`` is the dense arrival position (``assign_ids``).
    """
    chunked = df.withColumn("__chunk", index_chunk(index))
    out = scan(
        chunked,
        [Scan("__max", F.col("timestamp"), "max", inclusive=False)],
        chunks=["__chunk"],
        order=[index],
    )
    late = F.coalesce(F.col("timestamp") < F.col("__max"), F.lit(False))
    return out.withColumn("out_of_order", late).drop("__chunk", "__max")


def jump_relative(df: DataFrame, anchors: DataFrame, duration: str, forward: bool = True) -> DataFrame:
    """For every anchor (``record_index, timestamp``): the record nearest to its time ± duration.

    Distances are compared in whole milliseconds and the earlier record wins a tie.
    """
    micros = duration_ms(duration) * 1000 * (1 if forward else -1)
    target = F.timestamp_micros(F.unix_micros("timestamp") + F.lit(micros).cast("bigint"))
    wanted = anchors.select(F.col("record_index").alias("anchor_index"), target.alias("target_ts"))
    near = nearest_in_time(
        wanted, df, probe_ts="target_ts", mark_ts="timestamp", mark_index="record_index"
    )
    gap = lambda a, b: F.expr(f"(unix_micros({a}) - unix_micros({b})) div 1000")
    choose_prev = F.col("next_index").isNull() | (
        F.col("prev_index").isNotNull() & (gap("target_ts", "prev_ts") <= gap("next_ts", "target_ts"))
    )
    picked = near.select(
        "target_ts",
        F.when(choose_prev, F.col("prev_index")).otherwise(F.col("next_index")).alias("record_index"),
        F.when(choose_prev, F.col("prev_ts")).otherwise(F.col("next_ts")).alias("timestamp"),
    )
    return wanted.join(picked, "target_ts").select("anchor_index", "target_ts", "record_index", "timestamp")


def nearest_preceding(df: DataFrame, passing: Column, name: str = "nearest_index") -> DataFrame:
    """For every position: the last passing position up to it, else the first passing one."""
    hit = F.when(passing, F.col("record_index"))
    first = df.agg(F.min(hit)).scalar()
    out = scan(
        df.withColumn("__chunk", index_chunk()),
        [Scan("__hit", hit, "last")],
        chunks=["__chunk"],
        order=["record_index"],
    )
    return out.withColumn(name, F.coalesce("__hit", first)).drop("__hit", "__chunk")


def nearest_preceding_one(filtered: DataFrame, i: int) -> DataFrame:
    """The same for a single position: one aggregate."""
    idx = F.col("record_index")
    return filtered.agg(F.coalesce(F.max(F.when(idx <= i, idx)), F.min(idx)).alias("nearest_index"))


def with_view_index(df: DataFrame, passing: Column, name: str = "view_index") -> DataFrame:
    """The passing records with their position in the filtered view."""
    out = scan(
        df.filter(passing).withColumn("__chunk", index_chunk()),
        [Scan("__n", F.lit(1).cast("bigint"), "sum")],
        chunks=["__chunk"],
        order=["record_index"],
    )
    return out.withColumn(name, F.col("__n") - 1).drop("__n", "__chunk")


def page(df: DataFrame, offset: int, n: int, order: list[str] | None = None, index: str | None = None) -> DataFrame:
    """Rows ``[offset, offset + n)`` in time order (or ``order``).

    ``index`` names a column that holds dense positions already (``record_index`` of a whole
    store, ``view_index`` of a view): the page is then a range filter. Else the rows are numbered
    first. Either way the same at every depth.
    """
    if index is None:
        index = "__row"
        df = number_rows(df, order or time_key(df), index)
    found = df.filter((F.col(index) >= offset) & (F.col(index) < offset + n))
    return found.drop("__row")
