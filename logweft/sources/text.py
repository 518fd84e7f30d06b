"""Text and gzip log files as ``lines``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

_LOW33 = (1 << 33) - 1


def strip_cr(line: Column) -> Column:
    """Drop one trailing carriage return."""
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def as_line_rows(text: DataFrame, source: Column, block_start: Column, seq: Column, mod_year: Column) -> DataFrame:
    return text.select(
        source.alias("loader_id"),
        source.alias("source"),
        block_start.cast("bigint").alias("block_start"),
        seq.cast("bigint").alias("seq"),
        strip_cr(F.col("value")).alias("line"),
        mod_year.cast("int").alias("mod_year"),
    )


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files; ``.gz`` is unpacked by the reader. Empty lines stay.

    ``(source, block_start, seq)`` is the line order. Only ``\\n`` ends a line.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.option("lineSep", "\n").text(paths)
    return as_line_rows(
        text,
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)),
        F.year(F.col("_metadata.file_modification_time")),
    )


def sample_lines(lines: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` lines of every source.

    Only the first block of a source can hold them; the row-number limit is
    applied inside each task before anything is shuffled.
    """
    first = W.partitionBy("source").orderBy("block_start", "seq")
    return (
        lines.filter(F.col("block_start") == 0)
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= n)
        .drop("_rn")
    )
