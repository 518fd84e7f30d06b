"""Ordered scans (running sums, carry-forward, nearest value) without hot tasks.

A window over a whole source, rule or table puts that group into one task. Here
the group is cut into ordered *chunks*: a window runs inside each chunk, a small
aggregate keeps one row per chunk, the same scan runs over those rows, and the
chunk's carry-in is joined back. The rows are shuffled once, by (group, chunk);
only the per-chunk aggregate is shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# A chunk of a dense index holds at most this many positions.
CHUNK_BITS = 20


def index_chunk(index: str = "record_index") -> Column:
    """Chunk number of a dense position: even by construction."""
    return F.shiftright(F.col(index), CHUNK_BITS)


@dataclass(frozen=True)
class Scan:
    """One scan: ``kind`` of ``value`` over the rows up to this one.

    kind: ``sum``, ``min``, ``max`` or ``last`` (nearest non-null value).
    inclusive: whether the row itself counts. backward: scan from the end, so
    that ``last`` means the nearest value at or after the row.
    """

    out: str
    value: Column
    kind: str
    inclusive: bool = True
    backward: bool = False


def _agg(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, carried)
    if kind == "sum":
        return F.coalesce(carried + local, local, carried)
    return F.least(carried, local) if kind == "min" else F.greatest(carried, local)


def scan(
    df: DataFrame,
    scans: Sequence[Scan],
    *,
    by: Sequence[str] = (),
    chunks: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Add one column per scan.

    ``by`` (never NULL) separates independent groups, ``chunks`` lists the chunk
    columns from outermost to innermost and must be monotonic in ``order``.
    """
    by, chunks, order = list(by), list(chunks), list(order)
    keys = by + chunks
    forward_order = [F.col(c).asc() for c in order]
    backward_order = [F.col(c).desc() for c in order]

    def window(s: Scan, partition, fwd, bwd):
        w = W.partitionBy(*partition).orderBy(*(bwd if s.backward else fwd))
        return w.rowsBetween(W.unboundedPreceding, 0 if s.inclusive else -1)

    local = df.select(
        "*",
        *[
            _agg(s.kind, s.value).over(window(s, keys, forward_order, backward_order)).alias(f"__l{i}")
            for i, s in enumerate(scans)
        ],
    )

    position = F.struct(*[F.col(c) for c in order])

    def total(i: int, s: Scan) -> Column:
        if s.kind == "last":
            pick = F.min_by if s.backward else F.max_by
            return pick(s.value, F.when(s.value.isNotNull(), position)).alias(f"__t{i}")
        return _agg(s.kind, s.value).alias(f"__t{i}")

    totals = df.groupBy(*keys).agg(*[total(i, s) for i, s in enumerate(scans)])
    carried_specs = [
        Scan(f"__c{i}", F.col(f"__t{i}"), s.kind, inclusive=False, backward=s.backward) for i, s in enumerate(scans)
    ]
    if len(chunks) == 1:
        fwd, bwd = [F.col(chunks[0]).asc()], [F.col(chunks[0]).desc()]
        carried = totals.select(
            *keys,
            *[
                _agg(s.kind, s.value).over(window(s, by or [F.lit(0)], fwd, bwd)).alias(s.out)
                for s in carried_specs
            ],
        )
    else:
        carried = scan(totals, carried_specs, by=by, chunks=chunks[:-1], order=chunks[-1:])
        carried = carried.select(*keys, *[s.out for s in carried_specs])

    joined = local.join(carried, keys, "left")
    names = [c for c in df.columns]
    return joined.select(
        *names,
        *[_combine(s.kind, F.col(f"__c{i}"), F.col(f"__l{i}")).alias(s.out) for i, s in enumerate(scans)],
    )
