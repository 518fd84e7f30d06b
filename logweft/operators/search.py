"""Search, match numbers, next / previous match, highlights, bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regex import search as regex_search
from ..plans.scan import Scan, index_chunk, scan
from .ordering import with_view_index


def search_condition(pattern: str) -> Column:
    """Case-insensitive regex on message or raw text."""
    return F.coalesce(regex_search(F.col("message"), pattern, True), F.lit(False)) | F.coalesce(
        regex_search(F.col("raw"), pattern, True), F.lit(False)
    )


def search(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(search_condition(pattern))


def number_matches(df: DataFrame, pattern: str) -> DataFrame:
    """Matches with ``match_no`` (1…N) and ``match_total`` (N), in position order."""
    cond = search_condition(pattern)
    total = df.filter(cond).agg(F.count("*")).scalar()
    numbered = with_view_index(df, cond, "__k")
    return numbered.select(*df.columns, (F.col("__k") + 1).alias("match_no"), total.alias("match_total"))


def next_prev_match(df: DataFrame, cond: Column, *, include_self: bool = True) -> DataFrame:
    """For every position the next and previous match, wrapping around.

    ``include_self``: a matching record is its own next match (search); bookmarks
    jump strictly forward. The previous match is always strictly before.
    """
    hit = F.when(cond, F.col("record_index"))
    ends = df.agg(F.struct(F.min(hit).alias("lo"), F.max(hit).alias("hi"))).scalar()
    out = scan(
        df.withColumn("__chunk", index_chunk()),
        [
            Scan("__next", hit, "last", inclusive=include_self, backward=True),
            Scan("__prev", hit, "last", inclusive=False),
        ],
        chunks=["__chunk"],
        order=["record_index"],
    )
    return out.select(
        *df.columns,
        F.coalesce("__next", ends["lo"]).alias("next_match"),
        F.coalesce("__prev", ends["hi"]).alias("prev_match"),
    )


def next_match(df: DataFrame, cond: Column, i: int, *, strict: bool = False) -> DataFrame:
    """Next match from one position (at or after it, or after it when ``strict``)."""
    idx = F.col("record_index")
    ahead = idx > i if strict else idx >= i
    return df.filter(cond).agg(F.coalesce(F.min(F.when(ahead, idx)), F.min(idx)).alias("record_index"))


def prev_match(df: DataFrame, cond: Column, i: int) -> DataFrame:
    idx = F.col("record_index")
    return df.filter(cond).agg(F.coalesce(F.max(F.when(idx < i, idx)), F.max(idx)).alias("record_index"))


def tag_highlights(df: DataFrame, rules: list[tuple[str, str]], name: str = "highlight") -> DataFrame:
    """Tag each record with the last ``(name, regex)`` rule that matches its message."""
    tags = [F.when(regex_search(F.col("message"), p), F.lit(n)) for n, p in reversed(rules)]
    return df.withColumn(name, F.coalesce(*tags) if tags else F.lit(None).cast("string"))


def highlight_counts(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Matches of every rule, in rule order, zero included: one pass over the data."""
    wide = df.agg(*[F.count_if(regex_search(F.col("message"), p)).alias(f"c{i}") for i, (_, p) in enumerate(rules)])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("rule_ord"), F.lit(n).alias("rule"), F.col(f"c{i}").alias("matches"))
            for i, (n, _) in enumerate(rules)
        ]
    )
    return wide.select(F.inline(rows))


def bookmarked(df: DataFrame, ids) -> DataFrame:
    """Records whose id is in the set, with their position in the view.

    ``df`` is the filtered view with ``record_index``. ``ids`` is a list, or a
    DataFrame with a column ``id`` of any size; the join's strategy is Spark's choice.
    """
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame([(i,) for i in ids], "id bigint")
    marks = ids.select("id").distinct().withColumn("__mark", F.lit(True))
    flagged = df.join(marks, "id", "left").withColumn("__mark", F.col("__mark").isNotNull())
    numbered = with_view_index(flagged, F.lit(True))
    return numbered.filter("__mark").select(*df.columns, "view_index")
