"""Documents to training sequences: toxicity, quality, near-duplicates, packing.

Each stage works on what the one before kept and returns the columns of ``documents``; the last returns
packed pieces. ``run`` writes each stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweft.llm import linecrf, packing, simhash, toxicity  # noqa: E402
from logweft.llm.common import ship, small_batches  # noqa: E402
from logweft.llm.queries import CAPACITY, END_ID, GOOD_AT, TOXIC_AT, held_out, table, vocabulary  # noqa: E402
from logweft.session import materialize, tune  # noqa: E402

#: Entries of each memory of a worker: a JVM that runs all stages grows to its limit, and leaves its workers less room than that of one query.
REMEMBERED = 100_000


def _filtered(docs: DataFrame, scored: DataFrame, keep) -> DataFrame:
    return scored.filter(keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7. The model is fitted on this stage's documents."""
    small_batches(ship(tune(spark)))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(3, 1)), remembered=REMEMBERED)
    return _filtered(docs, toxicity.score(docs, model, out="__score", remembered=REMEMBERED), F.col("__score") < TOXIC_AT)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    small_batches(ship(tune(spark)))
    model = linecrf.fit(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    return _filtered(docs, linecrf.score(docs, model, out="__score"), F.col("__score") >= GOOD_AT)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates."""
    small_batches(ship(tune(spark)))
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 4096 tokens."""
    small_batches(ship(tune(spark)))
    return packing.pack_documents(docs.select("doc_id", "text"), vocabulary(), CAPACITY, END_ID, remembered=REMEMBERED).drop("slot")


STAGES = [
    ("toxicity", without_toxic),
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", without_near_duplicates),
    ("best_fit_packing", packed),
]

# Toxicity, quality and fingerprints are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
