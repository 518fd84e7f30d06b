"""Zip archives, and gzip files whose name Spark's text reader does not recognise."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .text import as_line_rows

_ROWS = "path string, modificationTime timestamp, seq bigint, value string"
# Lines handed to Spark at a time; an archive is never held unpacked as a whole.
_BATCH = 50_000


def _text_lines(stream) -> Iterator[str]:
    for line in io.TextIOWrapper(stream, encoding="utf-8", newline="\n"):
        yield line[:-1] if line.endswith("\n") else line


def _archive_lines(content: bytes, kind: str) -> Iterator[str]:
    if kind == "gzip":
        yield from _text_lines(gzip.GzipFile(fileobj=io.BytesIO(content)))
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for entry in z.infolist():
            if not entry.is_dir():
                with z.open(entry) as f:
                    yield from _text_lines(f)


def _unpack(kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, modified, content in zip(batch["path"], batch["modificationTime"], batch["content"]):
                held: list[str] = []
                done = 0
                for line in _archive_lines(content, kind):
                    held.append(line)
                    if len(held) == _BATCH:
                        yield _frame(path, modified, done, held)
                        done, held = done + len(held), []
                if held:
                    yield _frame(path, modified, done, held)

    return run


def _frame(path, modified, first: int, lines: list[str]) -> pd.DataFrame:
    n = len(lines)
    return pd.DataFrame(
        {"path": [path] * n, "modificationTime": [modified] * n, "seq": range(first, first + n), "value": lines}
    )


def _read(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "content")
    lines = files.mapInPandas(_unpack(kind), _ROWS)
    return as_line_rows(lines, F.col("path"), F.lit(0), F.col("seq"), F.year("modificationTime"))


def read_zip_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of all entries of zip archives, entry after entry; archives in parallel."""
    return _read(spark, paths, "zip")


def read_gzip_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of gzip files with any suffix (Spark itself knows only ``.gz``)."""
    return _read(spark, paths, "gzip")
