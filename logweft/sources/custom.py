"""Extension points: own parsers and own sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.parsers import Parser
from ..schema import PARSED_TYPE

_REGISTERED: dict[str, Parser] = {}


def register_parser(name: str, parse: Callable[[Column], Column]) -> Parser:
    """Make a function ``line -> struct of log fields (NULL: not mine)`` usable in a chain."""

    def build(prepared: Column, line: Column, year: Column) -> Column:
        return F.when(prepared.isNotNull(), prepared.cast(PARSED_TYPE))

    parser = Parser(name, (lambda line, year: parse(line),), build)
    _REGISTERED[name] = parser
    return parser


def registered_parser(name: str) -> Parser:
    return _REGISTERED[name]


class LineSource(DataSource):
    """Base for custom sources of raw lines; one input partition per path.

    Subclasses override ``partition_lines``; Spark runs it in parallel tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "logweft_lines"

    def schema(self) -> str:
        return "source string, seq bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self)

    def partitions(self) -> list[str]:
        return sorted(str(p) for p in Path(self.options["path"]).glob(self.options.get("glob", "*")) if p.is_file())

    def partition_lines(self, partition: str) -> Iterator[str]:
        with open(partition, encoding="utf-8", newline="\n") as f:
            for line in f:
                yield line.rstrip("\n")


class _LineReader(DataSourceReader):
    def __init__(self, source: LineSource):
        self.source = source

    def partitions(self):
        return [InputPartition(p) for p in self.source.partitions()]

    def read(self, partition):
        for seq, line in enumerate(self.source.partition_lines(partition.value)):
            yield partition.value, seq, line


def register_source(spark: SparkSession, source: type[DataSource] = LineSource) -> str:
    spark.dataSource.register(source)
    return source.name()
