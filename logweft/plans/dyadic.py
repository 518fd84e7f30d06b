"""Best interval over every position, without listing (position, interval) pairs.

Each interval is cut into at most 2·log2(length) aligned power-of-two blocks and
only the best interval of a block is kept; a position then has one candidate per
block size. The cost is O((intervals + positions) · log length) whatever the overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize, shuffled

# For lo ≤ x < hi, block k covers [a·2^k, (a+1)·2^k); a block is taken where the
# left edge (rounded up) or the right edge (rounded down) is odd at size k.
_BLOCKS = """
array_compact(flatten(transform(
  sequence(0, length(bin(end_index - start_index + 1)) - 1),
  k -> transform(
    array(struct(shiftright(start_index + shiftleft(1L, k) - 1, k) AS a, shiftright(end_index + 1, k) AS b)),
    e -> struct(k AS size, e.a AS a, e.b AS b)
  )
)))
"""


# From this size on a block may cover so many positions that its key is hot; there are few such blocks.
LARGE_BITS = 20
# Large blocks up to this many are sent to every task; more are joined by shuffle.
BROADCAST_BLOCKS = 200_000


def aligned_blocks(intervals: DataFrame, keep: str) -> DataFrame:
    """``keep, size, block``: the aligned power-of-two blocks that each interval (``start_index, end_index``) is made of."""
    edges = intervals.withColumn("e", F.explode(F.expr(_BLOCKS))).filter("e.a < e.b")
    left = F.when(F.col("e.a") % 2 == 1, F.col("e.a"))
    right = F.when(F.col("e.b") % 2 == 1, F.col("e.b") - 1)
    return edges.select(keep, F.col("e.size").alias("size"), F.explode(F.array_compact(F.array(left, right))).alias("block"))


def innermost_segments(intervals: DataFrame) -> DataFrame:
    """``at, best``: from position ``at`` up to the next row, the least ``best`` among the
    intervals (``start_index, end_index`` inclusive, ``best`` an orderable struct) that
    contain it; NULL where there is none.
    """
    intervals = materialize(intervals, "intervals")
    blocks = materialize(
        aligned_blocks(intervals, "best").groupBy("size", "block").agg(F.min("best").alias("best")), "blocks"
    )
    sizes = blocks.agg(F.max("size"), F.count_if(F.col("size") >= LARGE_BITS)).first()
    largest, n_large = sizes[0] or 0, sizes[1]
    points = materialize(
        intervals.select(F.explode(F.array(F.col("start_index"), F.col("end_index") + 1)).alias("at")).distinct(), "points"
    )

    def probed(lo: int, hi: int, table: DataFrame) -> DataFrame:
        probes = points.withColumn("size", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(
            "block", F.expr("shiftright(at, size)")
        )
        return probes.join(table, ["size", "block"]).select("at", "best")

    # Probes are many rows from a small file, so the choice of the join is not left to file sizes.

    found = probed(0, min(largest, LARGE_BITS - 1), shuffled(blocks.filter(F.col("size") < LARGE_BITS)))
    if largest >= LARGE_BITS:
        large = blocks.filter(F.col("size") >= LARGE_BITS)
        found = found.unionByName(probed(LARGE_BITS, largest, F.broadcast(large) if n_large <= BROADCAST_BLOCKS else shuffled(large)))
    return points.join(shuffled(found.groupBy("at").agg(F.min("best").alias("best"))), "at", "left")
