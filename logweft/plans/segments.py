"""A time-ordered store as sorted files with a fence for each: first position, first and last time, rows.

A lookup by time or position reads the fences (one row a file) and the one file it falls into, however
large the store is. Positions are not stored but follow from the fence and the row's place in its file, so
merging late rows into some files moves the later positions without touching their files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from ..session import materialize, scratch_path
from .scan import Scan, scan

#: first: position of the file's first row.
FENCE_SCHEMA = "file string, first bigint, lo timestamp, hi timestamp, rows bigint"
#: Fences up to this many are sent to every task that reads the store as a whole.
BROADCAST_FENCES = 200_000
_MICROS_A_DAY = 86_400_000_000


@dataclass(frozen=True)
class Store:
    """Sorted files and their fences; ``schema`` is that of the rows, ``time`` their time column."""

    fences: DataFrame
    schema: StructType
    time: str = "timestamp"

    @property
    def spark(self) -> SparkSession:
        return self.fences.sparkSession


def with_first(fences: DataFrame) -> DataFrame:
    """Positions from the rows of the files before; one row a file, so that one window holds them."""
    before = W.orderBy(F.col("lo").asc_nulls_first(), F.col("hi").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    return fences.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("file", "first", "lo", "hi", "rows")


def fences_of(spark: SparkSession, path: str, schema: StructType, time: str = "timestamp") -> DataFrame:
    """(file, lo, hi, rows) of the files below ``path``, from their time column alone."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count("*").alias("rows"))


def write_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """The rows in ``order``, a range of them in each file (overwrites ``path``)."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_store(df: DataFrame, order: Sequence[str], path: str | None = None) -> Store:
    """Sort ``df`` by ``order`` (the time, then what tells equal times apart) into files with fences."""
    spark, time = df.sparkSession, order[0]
    path = path or scratch_path(spark, "segments")
    write_sorted(df, f"{path}/data", order)
    fences = with_first(fences_of(spark, f"{path}/data", df.schema, time))
    fences.coalesce(1).write.mode("overwrite").parquet(f"{path}/fences")
    return open_store(spark, path, df.schema, time)


def open_store(spark: SparkSession, path: str, schema: StructType, time: str = "timestamp") -> Store:
    return Store(spark.read.schema(FENCE_SCHEMA).parquet(f"{path}/fences"), schema, time)


def _rows(store: Store, files: Sequence[str]) -> DataFrame:
    """Rows of some files with their place in the file."""
    if not files:
        return store.spark.createDataFrame([], store.schema).withColumns({"__file": F.lit(""), "__at": F.lit(0).cast("bigint")})
    rows = store.spark.read.schema(store.schema).parquet(*files)
    return rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))


def with_positions(store: Store, fences: DataFrame | None = None, name: str = "record_index") -> DataFrame:
    """The rows of the store, or of the files of some of its fences, with their positions."""
    fences = store.fences if fences is None else fences
    files = [r["file"] for r in fences.select("file").collect()]
    starts = fences.select(F.col("file").alias("__file"), "first")
    small = F.broadcast(starts) if len(files) <= BROADCAST_FENCES else starts
    rows = _rows(store, files).join(small, "__file")
    return rows.select(*store.schema.names, (F.col("first") + F.col("__at")).alias(name))


def size_of(store: Store) -> int:
    """Rows of the store, from the fences."""
    return store.fences.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def find_by_time(store: Store, ts) -> DataFrame:
    """One row: position of the first record at or after ``ts`` (the count if there is none). Reads one file."""
    at = F.lit(ts).cast("timestamp")
    fence = store.fences.filter(F.col("hi") >= at).orderBy("first").select("file", "first").limit(1).collect()
    if not fence:
        return store.spark.createDataFrame([(size_of(store),)], "record_index bigint")
    before = F.count_if(F.coalesce(F.col(store.time) < at, F.lit(True)))
    return _rows(store, [fence[0]["file"]]).agg((before + F.lit(fence[0]["first"])).alias("record_index"))


def range_by_position(store: Store, start: int, end: int, name: str = "record_index") -> DataFrame:
    """Positions [start, end), from the files that hold them."""
    touched = store.fences.filter((F.col("first") < end) & (F.col("first") + F.col("rows") > start))
    rows = with_positions(store, touched, name)
    return rows.filter((F.col(name) >= start) & (F.col(name) < end))


def time_slice(store: Store, start, end) -> DataFrame:
    """Records of [start, end), with positions, from the files that hold such times."""
    start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rows = with_positions(store, store.fences.filter((F.col("lo") < end) & (F.col("hi") >= start)))
    return rows.filter((F.col(store.time) >= start) & (F.col(store.time) < end))


# ------------------------------------------------------------------ late rows


def file_of(store: Store, late: DataFrame) -> DataFrame:
    """``late`` with ``__file``: the last file that begins at or before the row's time, else the first file.

    An ordered scan over the rows and the beginnings of the files, cut by days; no row meets more than one file.
    """
    names = late.columns
    begins = store.fences.filter(F.col("lo").isNotNull())
    marks = begins.select(
        F.col("lo").alias("__ts"), F.lit(0).alias("__kind"), F.col("first").alias("__nth"), F.col("file").alias("__begins"),
        F.lit(None).cast(late.select(F.struct(*names)).schema[0].dataType).alias("__row"),
    )
    rows = late.select(
        F.col(store.time).alias("__ts"), F.lit(1).alias("__kind"), F.lit(0).cast("bigint").alias("__nth"), F.lit(None).cast("string").alias("__begins"),
        F.struct(*names).alias("__row"),
    )
    both = marks.unionByName(rows).withColumn("__day", F.floor(F.unix_micros("__ts") / _MICROS_A_DAY))
    found = scan(both, [Scan("__found", F.col("__begins"), "last")], chunks=["__day"], order=["__ts", "__kind", "__nth"])
    first = begins.agg(F.min_by("file", "first").alias("f")).first()["f"]
    return found.filter("__kind = 1").select("__row.*", F.coalesce("__found", F.lit(first)).alias("__file"))


def merge_late(store: Store, late: DataFrame, order: Sequence[str], path: str) -> Store:
    """The store with the ``late`` rows where they belong: only files whose range they fall into are written anew.

    ``path`` takes the new files. Each of them holds rows of one old file, several if that got many rows.
    """
    spark = store.spark
    placed = materialize(file_of(store, late), "late-placed")
    touched = store.fences.join(placed.select(F.col("__file").alias("file")).distinct(), "file", "left_semi")
    files = [r["file"] for r in touched.select("file").collect()]  # names of files, as a reader needs them
    old = _rows(store, files).select(*store.schema.names, "__file")
    nth = touched.select(F.col("file").alias("__file"), F.col("first").alias("__nth"))
    small = F.broadcast(nth) if len(files) <= BROADCAST_FENCES else nth
    both = old.unionByName(placed.select(*old.columns)).join(small, "__file").drop("__file")
    sorted_rows = both.repartitionByRange("__nth", *order).sortWithinPartitions("__nth", *order)
    sorted_rows.write.mode("overwrite").partitionBy("__nth").parquet(path)
    made = fences_of(spark, path, store.schema, store.time)
    rest = store.fences.join(touched.select("file"), "file", "left_anti").drop("first")
    return Store(with_first(rest.unionByName(made)), store.schema, store.time)
