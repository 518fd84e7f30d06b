"""Counts, distributions, time density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import level_rank
from ..functions.regex import search as regex_search
from .predicates import predicate


def count_by_level(df: DataFrame) -> DataFrame:
    """Records per level; a missing level is a group of its own."""
    return df.groupBy("level").agg(F.count("*").alias("records"))


def view_stats(df: DataFrame, cond) -> DataFrame:
    """Per level, and in total (``is_total``): records before and after the filter, and the filter rate."""
    passed = predicate(cond)
    per_level = df.groupBy("level").agg(F.count("*").alias("total"), F.count_if(passed).alias("filtered"))
    # At most eight rows from here on.
    both = per_level.select(
        F.explode(F.array(F.lit(False), F.lit(True))).alias("is_total"), "level", "total", "filtered"
    )
    rolled = both.groupBy(
        "is_total", F.when(~F.col("is_total"), F.col("level")).alias("level")
    ).agg(F.sum("total").alias("total"), F.sum("filtered").alias("filtered"))
    rate = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.col("filtered") / F.col("total"))
    return rolled.withColumn("filter_rate", rate)


def level_distribution(df: DataFrame) -> DataFrame:
    """Count and percent of each level, in severity order; percent is of all rows."""
    counts = count_by_level(df)
    total = df.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    return (
        counts.filter(F.col("level").isNotNull())
        .select(
            "level",
            level_rank(F.col("level")).alias("level_rank"),
            "records",
            (F.col("records") / total * F.lit(100.0)).alias("percent"),
        )
        .orderBy("level_rank")
    )


def top_components(df: DataFrame, k: int = 10) -> DataFrame:
    """The k components with most records (ties by name)."""
    return (
        df.filter(F.col("component_name").isNotNull())
        .groupBy("component_name")
        .agg(F.count("*").alias("records"))
        .orderBy(F.desc("records"), F.asc("component_name"))
        .limit(k)
    )


def time_range_stats(df: DataFrame) -> DataFrame:
    lo, hi = F.min("timestamp"), F.max("timestamp")
    return df.agg(
        lo.alias("first_ts"),
        hi.alias("last_ts"),
        ((F.unix_micros(hi) - F.unix_micros(lo)) / 1000).cast("bigint").alias("span_ms"),
    )


def count_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("records"))


def _bounds(df: DataFrame) -> Column:
    return df.agg(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))).scalar()


def _offset_ms(ts: Column, lo: Column) -> Column:
    # The difference is cut to milliseconds, not its two ends.
    micros = F.unix_micros(ts) - F.unix_micros(lo)
    return F.floor(micros / 1000)


def bucket_of(ts: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bucket 0…n-1 of a time in ``[lo, hi]``; no range: bucket 0."""
    offset = _offset_ms(ts, lo).cast("double")
    spread = _offset_ms(hi, lo).cast("double")
    # Under a millisecond of spread 0/0 counts as 0.
    raw = F.when(spread > 0, offset / spread * F.lit(float(n - 1))).otherwise(F.lit(0.0))
    return F.least(F.floor(raw), F.lit(n - 1)).cast("int")


def category_bucket(ts: Column, lo: Column, hi: Column, n: int) -> Column:
    """The same with a range of at least 1 ms and offsets of at least 0."""
    offset = F.greatest(_offset_ms(ts, lo), F.lit(0)).cast("double")
    spread = F.greatest(_offset_ms(hi, lo), F.lit(1)).cast("double")
    return F.least(F.floor(offset / spread * F.lit(float(n - 1))), F.lit(max(n - 1, 0))).cast("int")


def _grid(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))


def subset(df: DataFrame, level: str | None = None, highlight: str | None = None) -> DataFrame:
    """Records a density may be asked for: all, of one level, or matching a regex on the raw line."""
    if level is not None:
        df = df.filter(F.col("level") == level)
    if highlight is not None:
        df = df.filter(F.coalesce(regex_search(F.col("raw"), highlight), F.lit(False)))
    return df


def density(df: DataFrame, n: int, level: str | None = None, highlight: str | None = None) -> DataFrame:
    """``bucket, records`` for n equal slices of the time range, empty ones included."""
    df = subset(df, level, highlight)
    b = _bounds(df)
    counts = df.groupBy(bucket_of(F.col("timestamp"), b["lo"], b["hi"], n).alias("bucket")).agg(
        F.count("*").alias("records")
    )
    return _grid(df, n).join(counts, "bucket", "left").select(
        "bucket", F.coalesce("records", F.lit(0)).alias("records")
    )


def density_by_level(df: DataFrame, n: int) -> DataFrame:
    """One column per level over a shared time range: a single pass for all levels."""
    from ..schema import LEVELS

    b = _bounds(df)
    bucket = bucket_of(F.col("timestamp"), b["lo"], b["hi"], n).alias("bucket")
    counts = df.groupBy(bucket).agg(
        F.count("*").alias("all_records"),
        *[F.count_if(F.col("level") == name).alias(name.lower()) for name in LEVELS],
    )
    cols = [c for c in counts.columns if c != "bucket"]
    return _grid(df, n).join(counts, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols]
    )


def density_heights(hist: DataFrame) -> DataFrame:
    """Bar heights 0-4 of a histogram (one row per bucket, a few hundred at most)."""
    used = F.when(F.col("records") > 0, F.col("records"))
    ends = hist.agg(F.struct(F.min(used).alias("lo"), F.max(used).alias("hi"))).scalar()
    ratio = (F.col("records") - ends["lo"]) / (ends["hi"] - ends["lo"]).cast("double")
    height = (
        F.when(F.col("records") == 0, F.lit(0))
        .when(ends["lo"] == ends["hi"], F.lit(2))
        .otherwise(F.floor(F.lit(1.5) + ratio * 3.0).cast("int"))
    )
    return hist.select("bucket", "records", height.alias("height"))


# Bucket widths a person reads easily, in milliseconds (1 ms to 24 h).
HUMAN_STEPS_MS = (
    1, 2, 5, 10, 20, 50, 100, 200, 500, 1_000, 2_000, 5_000, 10_000, 15_000, 30_000, 60_000, 120_000, 300_000, 600_000,
    900_000, 1_800_000, 3_600_000, 7_200_000, 21_600_000, 43_200_000, 86_400_000,
)


def snap_interval(ms: Column) -> Column:
    """Smallest human step at or above ``ms``; above 24 h unchanged."""
    out = F.when(ms <= 0, F.lit(1.0))
    for step in HUMAN_STEPS_MS:
        out = out.when(ms <= step, F.lit(float(step)))
    return out.otherwise(ms)


def interval_label(ms: Column) -> Column:
    """``500ms``, ``5s``, ``1.5m``, ``2h``."""

    def scaled(size: float, unit: str) -> Column:
        value = ms / F.lit(size)
        part = value - F.floor(value)
        whole = (part < 0.05) | (part > 0.95)
        return F.when(whole, F.concat(F.round(value).cast("bigint").cast("string"), F.lit(unit))).otherwise(
            F.format_string("%.1f" + unit, value)
        )

    return (
        F.when(ms < 1000, F.concat(F.round(ms).cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60_000, scaled(1000.0, "s"))
        .when(ms < 3_600_000, scaled(60_000.0, "m"))
        .otherwise(scaled(3_600_000.0, "h"))
    )


def density_width(df: DataFrame, n: int) -> DataFrame:
    """One row: raw and snapped milliseconds per bucket, and the label (NULL without a range)."""
    spread = F.when(
        F.min("timestamp") != F.max("timestamp"), _offset_ms(F.max("timestamp"), F.min("timestamp")).cast("double")
    )
    raw = df.agg((spread / float(n)).alias("raw_ms"))
    return raw.select(
        "raw_ms",
        snap_interval(F.col("raw_ms")).alias("step_ms"),
    ).select(
        "raw_ms",
        F.when(F.col("raw_ms").isNotNull(), F.col("step_ms")).alias("step_ms"),
        F.when(F.col("raw_ms").isNotNull(), interval_label(F.col("step_ms"))).alias("label"),
    )


def density_snapped(df: DataFrame, n: int) -> DataFrame:
    """Counts per slice of the snapped width, slices aligned to the epoch."""
    step = density_width(df, n).select((F.coalesce("step_ms", F.lit(1.0)) * 1000).cast("bigint")).scalar()
    micros = F.unix_micros("timestamp")
    start = F.timestamp_micros(micros - F.pmod(micros, step))
    return df.groupBy(start.alias("slice_start")).agg(F.count("*").alias("records"))


def resample(hist: DataFrame, target: int, n: int, value: str = "records") -> DataFrame:
    """Fewer bins by integer mean: bin i covers ``[⌊i·n/target⌋, ⌊(i+1)·n/target⌋)``.

    ``n`` is the number of buckets of ``hist``; with n ≤ target the bins are
    copied and padded with zeros.
    """
    bins = hist.sparkSession.range(target).select(F.col("id").cast("int").alias("bin"))
    if n <= target:
        values = hist.select(F.col("bucket").alias("bin"), F.col(value))
        return bins.join(values, "bin", "left").select("bin", F.coalesce(value, F.lit(0)).alias(value))
    step = n / target
    edges = [(i, int(i * step), min(int((i + 1) * step), n)) for i in range(target)]
    cover = hist.sparkSession.createDataFrame(
        [(i, b) for i, lo, hi in edges for b in range(lo, hi)], "bin int, bucket int"
    )
    means = (
        cover.join(hist, "bucket").groupBy("bin").agg(F.floor(F.sum(value) / F.count("*")).alias(value))
    )
    return bins.join(means, "bin", "left").select("bin", F.coalesce(value, F.lit(0)).alias(value))
