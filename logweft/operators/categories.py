"""Rule-based categories: a record may be in several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .aggregates import _bounds, category_bucket
from .predicates import predicate



def _rows(wide: DataFrame, keys: list[str], rules: list[tuple[str, object]]) -> DataFrame:
    """Long form (category_ord, category, records) of one count column per rule."""
    items = F.array(
        *[
            F.struct(F.lit(i).alias("category_ord"), F.lit(n).alias("category"), F.col(f"c{i}").alias("records"))
            for i, (n, _) in enumerate(rules)
        ]
    )
    return wide.select(*keys, F.inline(items))


def category_counts(df: DataFrame, rules: list[tuple[str, object]], share: bool = False) -> DataFrame:
    """Records per category in rule order, zeros included.

    All rules are tested in one pass and only one row of counts leaves each
    task. ``share`` adds the part of all records.
    """
    wide = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(predicate(p)).alias(f"c{i}") for i, (_, p) in enumerate(rules)],
    )
    out = _rows(wide, ["n"], rules)
    if share:
        ratio = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("records") / F.col("n"))
        return out.select("category_ord", "category", "records", ratio.alias("share"))
    return out.drop("n")


def category_density(df: DataFrame, rules: list[tuple[str, object]], n: int = 100) -> DataFrame:
    """Histogram of every category over the time range of all records."""
    b = _bounds(df)
    bucket = category_bucket(F.col("timestamp"), b["lo"], b["hi"], n).alias("bucket")
    wide = df.groupBy(bucket).agg(*[F.count_if(predicate(p)).alias(f"c{i}") for i, (_, p) in enumerate(rules)])
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    full = grid.join(wide, "bucket", "left").select(
        "bucket", *[F.coalesce(f"c{i}", F.lit(0)).alias(f"c{i}") for i in range(len(rules))]
    )
    return _rows(full, ["bucket"], rules)


def category_tags(df: DataFrame, rules: list[tuple[str, object]], name: str = "categories") -> DataFrame:
    """Add the array of categories of each record."""
    tags = F.array(*[F.when(predicate(p), F.lit(n)) for n, p in rules])
    return df.withColumn(name, F.array_compact(tags))


def filter_category(df: DataFrame, rules: list[tuple[str, object]], name: str) -> DataFrame:
    """Keep the records of one category."""
    found: list[Column] = [predicate(p) for n, p in rules if n == name]
    if not found:
        raise ValueError(f"no category {name!r}")
    return df.filter(found[0])
