"""Cross-entropy difference: how much likelier a text is under a target model than under a background model.

Both models are interpolated bigram models with the same smoothing over one vocabulary, the tokens
of a public BPE vocabulary. Bigrams are counted in every text. Texts are taken in blocks of about
``BLOCK_TOKENS`` tokens; a block sends its distinct bigrams with their counts to the table of
all bigrams, and gets back the corpus counts of those that occur in other blocks too. A bigram that
does not come back occurs in this block only, so its counts are known already. What is gathered
grows with the corpus; nothing of its size is sent to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from ..session import materialize
from .bpe import encoder
from .common import texts_of

#: Tokens of a block, about; a longer text is a block of its own.
BLOCK_TOKENS = 3_000_000
#: Smoothing: so many tokens of the unigram model are added to each context.
WEIGHT = 8.0


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _keys(texts: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(bigrams, text sizes): the token before the first of a text is ``begin``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    tokens = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = begin
    return (before << 32) | tokens, sizes


def _counted(keys: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct bigrams, target count, background count, number of the bigram at each token)."""
    distinct, where = np.unique(keys, return_inverse=True)
    t = np.bincount(where[marked], minlength=len(distinct))
    return distinct, t, np.bincount(where, minlength=len(distinct)) - t, where


def encoded_blocks(df: DataFrame, path: str, target: str, keep: list[str], text: str = "text") -> DataFrame:
    """Stored table: a row per text (``keep``, target, block, ids) and a row per block with its bigrams."""

    def run(batches):
        bpe = encoder(path)
        kind, begin = ("<u2" if bpe.largest < 65_536 else "<u4"), bpe.largest + 1
        block, texts, marks, size = TaskContext.get().partitionId() << 32, [], [], 0
        names = [*keep, "__target", "block", "ids", "grams"]

        def close():
            keys, sizes = _keys(texts, begin)
            distinct, t, n, _ = _counted(keys, np.repeat(np.array(marks, bool), sizes))
            grams = _pack(np.concatenate([np.diff(distinct, prepend=0), t, n]))
            return pa.RecordBatch.from_arrays([*nothing, pa.array([block]), pa.array([None], pa.binary()), pa.array([grams], pa.binary())], names=names)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in [*keep, "__target"]]
            nothing = [pa.nulls(1, c.type) for c in columns]
            at, packed, first = [], [], 0
            target_of = columns[-1].to_pylist()
            for i, t in enumerate(texts_of(batch, text)):
                ids = np.frombuffer(bpe.encode(t), "<u4").astype(kind)
                if texts and size + len(ids) > BLOCK_TOKENS:
                    if at:
                        yield pa.RecordBatch.from_arrays([*[c.slice(first, len(at)) for c in columns], pa.array(at), pa.array(packed, pa.binary()), pa.nulls(len(at), pa.binary())], names=names)
                    yield close()
                    block, texts, marks, size, at, packed, first = block + 1, [], [], 0, [], [], i
                texts.append(ids)
                marks.append(target_of[i])
                size += len(ids)
                at.append(block)
                packed.append(_pack(ids))
            if at:
                yield pa.RecordBatch.from_arrays([*[c.slice(first, len(at)) for c in columns], pa.array(at), pa.array(packed, pa.binary()), pa.nulls(len(at), pa.binary())], names=names)
        if texts:
            yield close()

    source = df.select(
        *[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{target}`").cast("boolean"), F.lit(False)).alias("__target"),
        F.col(f"`{text}`").cast("string").alias(text),
    )
    schema = StructType([StructField(f.name, f.dataType) for f in source.schema.fields if f.name in keep])
    schema = schema.add(StructField("__target", BooleanType())).add(StructField("block", LongType()))
    schema = schema.add(StructField("ids", BinaryType())).add(StructField("grams", BinaryType()))
    return materialize(source.mapInArrow(run, schema), "lm-tokens")


def _unfold(batches):
    for batch in batches:
        for block, grams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys, t, n = np.split(_unpack(grams, "<i8"), 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(t), block)), pa.array(np.cumsum(keys)), pa.array(t), pa.array(n)], names=["block", "key", "t", "n"]
            )


def cross_entropy_difference(
    df: DataFrame, path: str, target: str, keep: list[str], text: str = "text", weight: float = WEIGHT
) -> DataFrame:
    """For each row not marked: the columns ``keep``, n_tokens, target_loss, background_loss and score (their difference).

    ``target`` marks the rows (true) of the target corpus; all others (false, null) are the background, and are
    scored. Losses are per token, in natural logarithms; a text without tokens, null or empty,
    has losses and score 0. A negative score means closer to the target. Every row, repeated ones
    too, counts; without target rows the target model is uniform; an empty table gives no
    rows. Columns of ``keep`` with the names of the results are replaced.
    """
    new = ["n_tokens", "target_loss", "background_loss", "score"]
    keep = [c for c in keep if c not in new]
    largest = encoder(path).largest
    kind, begin, size = ("<u2" if largest < 65_536 else "<u4"), largest + 1, largest + 2
    stored = encoded_blocks(df, path, target, keep, text)
    counted = stored.filter("grams IS NOT NULL").select("block", "grams").mapInArrow(_unfold, "block long, key long, t long, n long")
    total = materialize(
        counted.groupBy("key").agg(F.sum("t").alias("T"), F.sum("n").alias("N"), F.count("*").alias("blocks")), "lm-bigrams"
    )

    def dense(token) -> dict[str, np.ndarray]:
        """Counts by token: two numbers for each of the vocabulary, whatever the corpus."""
        rows = total.groupBy(token.alias("token")).agg(F.sum("T").alias("t"), F.sum("N").alias("n")).toArrow()
        out = {"t": np.zeros(size), "n": np.zeros(size)}
        for c, x in out.items():
            x[rows["token"].to_numpy()] = rows[c].to_numpy()
        return out

    single, context = dense(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))), dense(F.shiftright("key", 32))
    share = {c: ((x + 1) / (x.sum() + size)).astype(np.float32) for c, x in single.items()}
    context = {c: x.astype(np.float32) for c, x in context.items()}
    again = counted.select("block", "key").join(total.filter("blocks > 1"), "key").select(
        F.col("block").alias("b_block"), F.col("key").alias("b_key"), "T", "N"
    )
    schema = StructType([f for f in stored.schema.fields if f.name in keep])
    schema = schema.add(StructField("n_tokens", LongType()))
    for name in new[1:]:
        schema = schema.add(StructField(name, DoubleType()))

    def rate(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, sizes = _keys([_unpack(x, kind) for x in table["ids"].to_pylist()], begin)
        marks = np.array(table["__target"].to_pylist(), bool)
        distinct, t, n, where = _counted(keys, np.repeat(marks, sizes))
        counts = {"t": t.astype(float), "n": n.astype(float)}
        at = np.searchsorted(distinct, known["b_key"].to_numpy())
        counts["t"][at], counts["n"][at] = known["T"].to_numpy(), known["N"].to_numpy()
        ends, out = np.cumsum(sizes), {}
        for c in ("t", "n"):
            p = (counts[c] + weight * share[c][distinct & 0xFFFFFFFF]) / (context[c][distinct >> 32] + weight)
            sums = np.concatenate([[0.0], np.cumsum(-np.log(p)[where])])
            out[c] = (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)
        columns = [*[table[c] for c in keep], pa.array(sizes), *map(pa.array, (out["t"], out["n"], out["t"] - out["n"]))]
        return pa.table(columns, names=[*keep, *new]).filter(pa.array(~marks))

    texts = stored.filter("grams IS NULL").select(*keep, "__target", "block", "ids")
    return texts.groupBy("block").cogroup(again.groupBy("b_block")).applyInArrow(rate, schema)
