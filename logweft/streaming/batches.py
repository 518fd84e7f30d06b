"""Small state kept between micro-batches, as one table per batch in shared storage.

A batch reads the state of the batch before and overwrites its own, so a batch that is run again
after a failure gives the same result. Batch numbers follow each other, so nothing is listed
while a stream runs; of the state only the last two tables are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def batch_path(base: str, batch_id: int) -> str:
    return f"{base}/batch={batch_id:012d}"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    found, fs = _path(spark, path)
    fs.delete(found, True)


def write_batch(df: DataFrame, base: str, batch_id: int) -> None:
    """A result table of the batch; all of them together are the output."""
    df.write.mode("overwrite").parquet(batch_path(base, batch_id))


def write_state(df: DataFrame, base: str, batch_id: int) -> None:
    """The state after the batch. That before it stays, for a repeated batch; older state goes."""
    write_batch(df, base, batch_id)
    if batch_id >= 2:
        delete(df.sparkSession, batch_path(base, batch_id - 2))


def state_before(spark: SparkSession, base: str, batch_id: int, schema) -> DataFrame:
    """State that the batch before this one left (no rows for the first batch)."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_path(base, batch_id - 1))


def _names(spark: SparkSession, base: str) -> list[str]:
    """Batches that are complete: a part file only appears when its batch is committed."""
    path, fs = _path(spark, base)
    if not fs.exists(path):
        return []
    return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith("batch="))


def all_batches(spark: SparkSession, base: str, schema) -> DataFrame:
    if not _names(spark, base):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/batch=*")


def last_batch(spark: SparkSession, base: str, schema) -> DataFrame:
    names = _names(spark, base)
    return spark.read.schema(schema).parquet(f"{base}/{names[-1]}") if names else spark.createDataFrame([], schema)
