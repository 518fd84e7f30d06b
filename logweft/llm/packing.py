"""Best-two-fit packing of token sequences into fixed-length training sequences.

A bin is filled greedily, largest fitting piece first; then its smallest piece is taken out again
if two pieces not yet packed fill the wider gap more tightly (Friesen and Langston's best-two-fit).
Pieces are dealt evenly over groups of about ``GROUP_BINS`` bins; a group is one task's work and
wastes at most about one bin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import materialize
from .bpe import encoder
from .common import texts_of

#: Bins and pieces of a group at most, about. A group must fit a task's memory; it needs a few MB.
GROUP_BINS, GROUP_PIECES = 2_048, 60_000

PIECE = "piece int, start long, length long, ids_crc32 long, slot long"


def pieces(
    df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", remembered: int | None = None
) -> DataFrame:
    """One row per piece: the columns of ``df`` without the text, and piece, start, length, ids_crc32, slot.

    A document is its ids and ``end_id`` (null and empty texts: ``end_id`` alone); only longer ones
    are cut, into pieces of ``capacity`` ids, the last one may be shorter. ``slot`` numbers the pieces
    by task. Columns of ``df`` with the names of the new columns are replaced; repeated rows
    are packed as often as they occur; an empty table has no pieces. ``remembered`` bounds what an encoder keeps (``bpe.encoder``).
    """
    new = [
        StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
        StructField("ids_crc32", LongType()), StructField("slot", LongType()),
    ]
    names = [f.name for f in new]
    keep = [c for c in df.columns if c not in names and c != text]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        bpe = encoder(path, remembered)
        slot = TaskContext.get().partitionId() << 36
        step = capacity * 4
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(bpe.encode_all(texts_of(batch, text))):
                ids += end
                for n, lo in enumerate(range(0, len(ids), step)):
                    part = ids[lo : lo + step]
                    at.append(i)
                    piece.append(n)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            rows = pa.array(at, pa.int64())
            kept = [batch.column(batch.schema.get_field_index(c)).take(rows) for c in keep]
            slots = pa.array(range(slot, slot + len(at)), pa.int64())
            slot += len(at)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)], slots],
                names=[*keep, *names],
            )

    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(text))
    return source.mapInArrow(run, StructType([*[df.schema[c] for c in keep], *new]))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Lengths are from 1 to ``capacity``; ties go to the piece that comes first."""
    order = np.argsort(lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    free = 0  # bit n: a piece of length n is left
    for n in stacks:
        free |= 1 << n
    upto = [(2 << n) - 1 for n in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal free
        i = stacks[n].pop()
        if not stacks[n]:
            free &= ~(1 << n)
        return i

    number = 0
    while free:
        gap, chosen = capacity, []
        while gap and (n := (free & upto[gap]).bit_length() - 1) > 0:
            chosen.append(take(n))
            gap -= n
        if gap and free:
            smallest = int(lengths[chosen[-1]])
            wide, best = gap + smallest, (smallest, 0)
            a = (free & upto[wide - 1]).bit_length() - 1
            while a > 0 and 2 * a > best[0] and best[0] < wide:
                b = (free & upto[min(a, wide - a)]).bit_length() - 1
                if b == a and len(stacks[a]) < 2:
                    b = (free & upto[a - 1]).bit_length() - 1
                if b > 0 and a + b > best[0]:
                    best = (a + b, a)
                a = (free & upto[a - 1]).bit_length() - 1
            if best[1]:
                back = chosen.pop()
                stacks[smallest].append(back)
                free |= 1 << smallest
                chosen += [take(best[1]), take(best[0] - best[1])]
        at = 0
        for i in chosen:
            bins[i], offsets[i] = number, at
            at += int(lengths[i])
        number += 1
    return bins, offsets


def pack(pieces_table: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces that is stored (it is read twice)."""
    full = F.col("length") == capacity
    rest = pieces_table.filter(~full)
    n, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-tokens // (capacity * GROUP_BINS)), -(-n // GROUP_PIECES))
    # Slots run through each task's pieces, so this deals them out evenly whatever the documents are.
    group = F.pmod(F.col("slot") + F.shiftright("slot", 36) * 7919, F.lit(groups))
    columns = [F.col(f"`{c}`") for c in pieces_table.columns if c not in ("sequence_id", "offset")]
    schema = StructType(
        [f for f in pieces_table.schema.fields if f.name not in ("sequence_id", "offset")]
        + [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        bins, offsets = best_two_fit(table["length"].to_numpy(), capacity)
        first = table["__group"][0].as_py() << 32
        return table.drop_columns(["__group"]).append_column("sequence_id", pa.array(bins + first)).append_column(
            "offset", pa.array(offsets)
        )

    packed = rest.select(*columns, group.alias("__group")).groupBy("__group").applyInArrow(run, schema)
    whole = pieces_table.filter(full).select(
        *columns, (-1 - F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)


def pack_documents(
    df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", remembered: int | None = None
) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its place.

    Returns the columns of ``df`` without the text, and piece, start, length, ids_crc32, slot,
    sequence_id, offset. Sequences are filled without gaps from offset 0 and hold at most
    ``capacity`` ids. See ``pieces`` for nulls, empty texts, repeated rows, clashing names and ``remembered``.
    """
    stored = materialize(pieces(df, path, capacity, end_id, text, remembered), "pieces")
    return pack(stored, capacity)
