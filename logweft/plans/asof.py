"""As-of lookup on timestamps: nearest marks before and after given instants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .scan import Scan, scan


def nearest_in_time(
    probes: DataFrame,
    marks: DataFrame,
    *,
    by: Sequence[str] = (),
    probe_ts: str,
    mark_ts: str,
    mark_index: str,
) -> DataFrame:
    """For each distinct probe instant: the last mark before it and the first mark
    at or after it, as ``prev_index, prev_ts, next_index, next_ts``.

    Both sides shrink to one row per instant first, so one second holds at most
    10^6 rows and one day 86,400 seconds: every window below has a fixed bound
    however the records bunch up in time.
    """
    by = list(by)
    m = marks.groupBy(*by, F.col(mark_ts).alias("_t")).agg(
        F.min(mark_index).alias("_first"), F.max(mark_index).alias("_last")
    )
    p = probes.select(*by, F.col(probe_ts).alias("_t")).distinct()
    nothing = F.lit(None).cast("bigint")
    both = (
        m.select(*by, "_t", "_first", "_last", F.lit(False).alias("_probe"))
        .unionByName(p.select(*by, "_t", nothing.alias("_first"), nothing.alias("_last"), F.lit(True).alias("_probe")))
        .groupBy(*by, "_t")
        .agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_probe").alias("_probe"))
        .withColumn("_us", F.unix_micros("_t"))
        .withColumn("_sec", F.expr("_us div 1000000"))
        .withColumn("_day", F.expr("_sec div 86400"))
    )
    before = F.when(F.col("_last").isNotNull(), F.struct(F.col("_last").alias("i"), F.col("_t").alias("t")))
    after = F.when(F.col("_first").isNotNull(), F.struct(F.col("_first").alias("i"), F.col("_t").alias("t")))
    found = scan(
        both,
        [
            Scan("_prev", before, "last", inclusive=False),
            Scan("_next", after, "last", inclusive=True, backward=True),
        ],
        by=by,
        chunks=["_day", "_sec"],
        order=["_us"],
    )
    return found.filter("_probe").select(
        *by,
        F.col("_t").alias(probe_ts),
        F.col("_prev.i").alias("prev_index"),
        F.col("_prev.t").alias("prev_ts"),
        F.col("_next.i").alias("next_index"),
        F.col("_next.t").alias("next_ts"),
    )
