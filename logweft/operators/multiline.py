"""Multi-line records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.regex import search
from ..plans.scan import CHUNK_BITS, Scan, scan


def merge_multiline(lines: DataFrame, start_regex: str, sep: str = "\n") -> DataFrame:
    """Join each line that does not match ``start_regex`` to the record before it.

    The position of the record's first line names the record, so no running
    record number is needed. Lines before a source's first start form one
    record. Text is joined per chunk of lines first, then per record.
    """
    start = F.coalesce(search(F.col("line"), start_regex), F.lit(False))
    place = F.struct("block_start", "seq")
    order = ["block_start", "seq"]
    tagged = scan(
        lines.withColumn("_chunk", F.shiftright("seq", CHUNK_BITS)),
        [Scan("_first", F.when(start, place), "last")],
        by=["source"],
        chunks=["block_start", "_chunk"],
        order=order,
    )

    def joined(at: str, text: str):
        rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("text"))))
        return F.concat_ws(sep, F.transform(rows, lambda r: r["text"]))

    record = ["loader_id", "source", "mod_year", "_first"]
    pieces = tagged.groupBy(*record, "block_start", "_chunk").agg(
        F.min(place).alias("_at"), joined("seq", "line").alias("_text"), F.count("*").alias("_n")
    )
    merged = pieces.groupBy(*record).agg(
        F.min("_at").alias("_at"), joined("_at", "_text").alias("line"), F.sum("_n").alias("n_lines")
    )
    return merged.select(
        "loader_id",
        "source",
        F.col("_at.block_start").alias("block_start"),
        F.col("_at.seq").alias("seq"),
        "line",
        "mod_year",
        "n_lines",
    )
