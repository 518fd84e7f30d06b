"""Parts shared by the operators: rows passed through Arrow batches with columns added, hashes, components."""

from __future__ import annotations

import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..session import materialize

def _fields(ddl: str) -> list[StructField]:
    return list(_parse_datatype_string(ddl).fields)


def add_columns(df: DataFrame, ddl: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``df`` with the columns of ``ddl``, which ``make`` works out from each Arrow batch.

    Input columns of the same names are replaced. Rows stay where they are: no shuffle.
    """
    new = _fields(ddl)
    names = [f.name for f in new]
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    schema = StructType([*base.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch)], names=[*batch.schema.names, *names])

    return base.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


#: Emptied by ``forget``: what operators remember in a worker between the tasks of one job.
MEMORIES: list[Callable[[], None]] = []


def forget(but: Callable[[], None] | None = None) -> None:
    """Give back what earlier jobs left in this worker; for operators that need the room in a pipeline. ``but``: the caller's own."""
    for empty in MEMORIES:
        if empty != but:
            empty()
    pa.default_memory_pool().release_unused()


def crc_mod(value: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % n


def crc32_text(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b; long, not null) can reach.

    Alternating large-star and small-star steps (Kiveris et al., "Connected components in
    MapReduce and beyond"): every step is a minimum per node, combined before the shuffle, and
    an equality join of the edges with it; the number of edges never grows. Each round is
    written to the shared folder. Nodes without an edge to another node are not returned.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialize(
        edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), label
    )
    before = None
    while True:
        both = edges.unionAll(edges.select(b.alias("a"), a.alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("__m")).select("a", F.least("a", "__m").alias("__m"))
        large = both.join(lowest, "a").filter(b > a).select(b.alias("a"), F.col("__m").alias("b")).filter(a != b)
        large = materialize(large.distinct(), label)
        low = large.groupBy("a").agg(F.min("b").alias("__m"))
        small = large.join(low, "a").select(F.explode(F.array(a, b)).alias("a"), F.col("__m").alias("b")).filter(a != b)
        edges = materialize(small.distinct(), label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(a.alias("node"), b.alias("root")).unionAll(
                edges.select(b.alias("node"), b.alias("root")).distinct()
            )
        before = state


#: Bits of a filter: 8 MB, however many values it stands for. More values make it pass more rows, not grow.
FILTER_BITS = 1 << 26


def may_be_in(df: DataFrame, column: str, values: DataFrame, out: str) -> DataFrame:
    """Add ``out``: false only if ``column`` is none of the ``values`` (one column of the same type, none null).

    A bitmap of hashed values in ``FILTER_BITS`` is broadcast, so rows stay where they are: of ten million values
    it tells apart 86 % of the others, of one million 98 %.
    """
    def place(name: str) -> Column:
        return F.xxhash64(F.col(f"`{name}`")).bitwiseAND(F.lit(FILTER_BITS - 1))

    bits = 1 << 15  # of a bitmap of Spark's
    at = values.select(place(values.columns[0]).alias("__at"))
    at = at.select(F.floor(F.col("__at") / bits).alias("__block"), (F.col("__at") % bits).alias("__bit"))
    # Dealt out before, so that a task holds each of its bitmaps once.
    maps = at.repartition("__block").groupBy("__block").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    own = place(column)
    byte = F.conv(F.hex(F.substring("__map", F.floor(own % bits / 8).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (own % 8).cast("int")) == 1, F.lit(False))
    joined = df.withColumn("__block", F.floor(own / bits)).join(F.broadcast(maps), "__block", "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], found.alias(out))


def rows_in(df: DataFrame, column: str, wanted: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in ``wanted``; all values are either there or in ``others`` (both stored, one column).

    As a semi-join, but only rows that the filters of both let pass are shuffled.
    """
    told = may_be_in(may_be_in(df, column, wanted, "__wanted"), column, others, "__other")
    unsure = told.filter("__wanted AND __other").join(wanted.withColumnRenamed(wanted.columns[0], column), column, "left_semi")
    names = [F.col(f"`{c}`") for c in df.columns]
    return told.filter("NOT __other").select(*names).unionByName(unsure.select(*names))


#: Bytes of an Arrow batch. Each running task holds some of them, in the JVM and in its Python worker, besides what operators remember.
BATCH_BYTES = 1 << 20
#: Rows that a Parquet reader holds at once; Spark's 4,096 whole texts are arrays of many MB, each of which must lie in one piece.
READ_ROWS = 256


def small_batches(spark: SparkSession) -> SparkSession:
    """Let tasks read ``READ_ROWS`` at a time and pass them to Python in batches of ``BATCH_BYTES``; 10,000 whole texts may be far more."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the tasks' Python this package, once per application, wherever it was imported from.

    Jobs submitted with the package installed or with ``--py-files`` do not need it.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix=f"{package.name}-")  # the driver serves it from here
        path = f"{folder}/{package.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
