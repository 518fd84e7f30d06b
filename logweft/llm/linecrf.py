"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is good or bad; what speaks for it are its own features and those of the lines before
and after, and the states of neighbouring lines hang together. Labels are known for documents only: a good
document has good lines throughout, a bad one at least one bad line, and which they are is left to the model.
Forward-backward gives each line's chance of being good; their mean, weighted by line length, becomes the
document's score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import add_columns, forget, texts_of

#: Labelled documents that the model is fitted on, at most, in the order of a hash of their ids ...
TRAIN_DOCS = 4_000
#: ... the most lines that such a document may have; longer ones teach nothing but are scored whole ...
TRAIN_LINES = 1_000
#: ... and the most lines of all of them; the driver's matrices hold so many rows of 37 numbers.
TRAIN_TOTAL = 200_000
STEPS, RATE, RIDGE = 120, 0.15, 1e-3

# Classes of bytes, by which lines are described.
_UPPER, _LOWER, _DIGIT, _SIGN, _STOP, _HIGH, _SPACE, _REST = b"ULDSPHW."
_TABLE = bytearray([_REST] * 256)
for _chars, _kind in (
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT),
    (b"#*$%&|<>", _SIGN), (b".,;:?!", _STOP), (bytes(range(128, 256)), _HIGH), (b" \t\n\r\x0b\x0c", _SPACE),
):
    for _c in _chars:
        _TABLE[_c] = _kind
_TABLE = bytes(_TABLE)

OWN = 12  # features of a line itself
FEATURES = 3 * OWN + 1


def line_features(text: bytes) -> tuple[list[tuple[float, ...]], list[int]]:
    """(features, length) of each line that has a word."""
    rows, lengths, seen = [], [], set()
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        kinds = line.translate(_TABLE)
        n, w = len(line), len(words)
        letters = kinds.count(b"L") + kinds.count(b"H") + kinds.count(b"U")
        signs = kinds.count(b"S")
        distinct = len(set(words))
        rows.append((
            min(signs / w, 3.0),
            kinds.count(b"U") / max(letters, 1),
            kinds.count(b"D") / n,
            min(line.count(b"|") / w, 1.0),
            min(line.count(b"!") / w, 2.0),
            min(kinds.count(b"P") / w, 2.0),
            sum(map(eq, words, words[1:])) / w,
            1.0 - distinct / w,
            1.0 if line in seen else 0.0,
            min(n / w, 30.0) / 10.0,
            1.0 if w < 4 else 0.0,
            min(math.log1p(w), 6.0) / 3.0,
        ))
        seen.add(line)
        lengths.append(n)
    return rows, lengths


def _matrix(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same document (else zero), and 1."""
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    before[starts] = 0
    after[starts[1:] - 1] = 0
    return np.concatenate([rows, before, after, np.ones((len(rows), 1))], axis=1)


@dataclass(frozen=True)
class LineModel:
    weights: tuple[float, ...]  # for good against bad, of the scaled features
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    transitions: tuple[float, float, float, float]  # log-weights bad-bad, bad-good, good-bad, good-good
    slope: float  # the logistic curve from mean marginal to score
    shift: float
    base: float  # score of documents without a line


@dataclass(frozen=True)
class _Chain:
    bad: np.ndarray  # each line's chance of being bad
    at: np.ndarray  # the lines that have one before them in their document
    moves: np.ndarray  # for each of these the chances of the four transitions (2 x 2)
    log_good: np.ndarray  # for each document the logarithm of the chance that all its lines are good


def _chain(emission: np.ndarray, starts: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> _Chain:
    """Forward-backward over all documents, which advance together, longest first: a step is one array operation."""
    total = int(counts.sum())
    order = np.argsort(-counts, kind="stable")
    first, length = starts[order], counts[order]
    active = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    e = np.stack([np.zeros(total), np.clip(emission, -30, 30)], axis=1)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    forward, backward, norm = np.empty((total, 2)), np.ones((total, 2)), np.empty(total)
    for t, k in enumerate(active):
        at = first[:k] + t
        f = e[at] if t == 0 else (forward[at - 1] @ pair) * e[at]
        norm[at] = f.sum(axis=1)
        forward[at] = f / norm[at, None]
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        b = (backward[at] * e[at]) @ pair.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    inner = np.ones(total, bool)
    inner[starts[counts > 0]] = False
    at = np.flatnonzero(inner)
    joint = forward[at - 1][:, :, None] * pair[None] * (backward[at] * e[at])[:, None, :]
    steps = np.log(e[:, 1]) + inner * np.log(pair[1, 1]) - np.log(norm)
    sums = np.concatenate([[0], np.cumsum(steps)])
    return _Chain(
        both[:, 0] / both.sum(axis=1), at, joint / joint.sum(axis=(1, 2), keepdims=True),
        np.minimum(sums[starts + counts] - sums[starts], 0.0),
    )


def _marginals(emission: np.ndarray, starts: np.ndarray, counts: np.ndarray, pair: np.ndarray, pairs: bool = False):
    """Each line's chance of being good; with ``pairs`` also the expected transitions (2 x 2)."""
    chain = _chain(emission, starts, counts, pair)
    return (1 - chain.bad, chain.moves.sum(axis=0)) if pairs else 1 - chain.bad


def _log_likelihood(theta: np.ndarray, x: np.ndarray, counts: np.ndarray, quality: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the documents' labels, without ridge, and its slope.

    The chance of a good label is that of all lines being good; a bad one has the rest, summed over all other ways to
    label the lines. So the slope of a bad document is that of a good one by -p / (1 - p).
    """
    starts = np.cumsum(counts) - counts
    chain = _chain(x @ theta[:FEATURES], starts, counts, np.exp(theta[FEATURES:].reshape(2, 2)))
    taught = counts > 0  # a document without lines tells nothing of them
    rest = np.maximum(-np.expm1(chain.log_good), 1e-12)
    weight = np.where(quality > 0, 1.0, -np.exp(chain.log_good) / rest) * taught
    line = np.repeat(weight, counts)
    all_good = np.array([[0.0, 0.0], [0.0, 1.0]])
    moves = (line[chain.at, None, None] * (all_good - chain.moves)).sum(axis=0)
    value = np.where(quality > 0, chain.log_good, np.log(rest))[taught].sum()
    return float(value), np.concatenate([x.T @ (line * chain.bad), moves.ravel()])


def _weighted(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean per document, weighted by line length; nan without lines."""
    ends = np.cumsum(counts)
    sums = np.concatenate([[0], np.cumsum(values * lengths)])
    weight = np.concatenate([[0], np.cumsum(lengths)])
    with np.errstate(invalid="ignore", divide="ignore"):
        return (sums[ends] - sums[ends - counts]) / (weight[ends] - weight[ends - counts])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _train(rows: np.ndarray, lengths: np.ndarray, counts: np.ndarray, quality: np.ndarray) -> LineModel:
    """Likelihood of the documents' labels over all ways to label their lines, by gradient steps."""
    base = float((quality.sum() + 1) / (len(quality) + 2))
    if len(rows) == 0 or quality.min() == quality.max():  # nothing to tell apart
        return LineModel((0.0,) * FEATURES, (0.0,) * FEATURES, (1.0,) * FEATURES, (0.0,) * 4, 0.0, math.log(base / (1 - base)), base)
    starts = np.cumsum(counts) - counts
    x = _matrix(rows, starts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean[-1], scale[-1] = 0.0, 1.0
    x = (x - mean) / scale
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        slope = _log_likelihood(theta, x, counts, quality)[1] / len(x) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta[FEATURES:] = np.clip(theta[FEATURES:], -4, 4)
    good = _marginals(x @ theta[:FEATURES], starts, counts, np.exp(theta[FEATURES:].reshape(2, 2)))
    z = _logit(_weighted(good, lengths, counts))
    has = counts > 0
    a, b = _curve(z[has], quality[has].astype(float))
    return LineModel(
        tuple(theta[:FEATURES].tolist()), tuple(mean.tolist()), tuple(scale.tolist()), tuple(theta[FEATURES:].tolist()), a, b, base
    )


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not below zero) and shift of a logistic curve, with a little ridge, by Newton steps."""
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.5 * (w - np.array([1.0, 0.0]))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        w = w + np.linalg.solve(h, g)
    return max(float(w[0]), 0.0), float(w[1])


def fit(
    docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES, train_total: int = TRAIN_TOTAL,
    id_column: str = "doc_id", text: str = "text",
) -> LineModel:
    """Fit on at most ``train_docs`` of the labelled rows given (``id_column``, quality), in the order of a hash of their
    ids, and at most ``train_total`` lines.

    Rows with a null id or label teach nothing; a document labelled twice counts as good only if all its labels
    say so; a repeated document teaches once. Texts without a line teach the base only.
    """
    sample = (
        labels.select(F.col(f"`{id_column}`").alias("id"), F.col("quality").cast("int").alias("quality")).dropna()
        .groupBy("id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id").limit(train_docs)
    )
    taught = (
        docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
        .join(F.broadcast(sample), "id")  # at most train_docs rows
    )

    def run(batches):
        forget()
        for batch in batches:
            ids, quality = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = []
            for i, t, q in zip(ids, texts_of(batch), quality):
                rows, lengths = line_features(t)
                if len(rows) <= train_lines:
                    out.append((i, q, np.asarray(rows, np.float32).tobytes(), np.asarray(lengths, np.int32).tobytes()))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "quality", "rows", "lengths"])

    found = (
        taught.select(F.col("id").cast("long").alias("id"), "text", "quality")
        .mapInArrow(run, "id long, quality int, rows binary, lengths binary")
        .dropDuplicates(["id"])
    )
    taken, total = [], 0
    for r in found.orderBy(F.xxhash64("id"), "id").toLocalIterator():  # at most train_docs rows; they end at train_total lines
        total += len(r["lengths"]) // 4
        if total > train_total:
            break
        taken.append(r)
    if not taken:
        return _train(np.zeros((0, OWN)), np.zeros(0), np.zeros(0, int), np.ones(1))
    lengths = [np.frombuffer(r["lengths"], np.int32) for r in taken]
    rows = np.concatenate([np.frombuffer(r["rows"], np.float32).reshape(-1, OWN) for r in taken]).astype(float)
    return _train(rows, np.concatenate(lengths).astype(float), np.array([len(x) for x in lengths]), np.array([r["quality"] for r in taken]))


def _good_lines(texts: list[bytes], model: LineModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of being good and length of each line that has a word, number of such lines of each text)."""
    rows, lengths, counts = [], [], []
    for t in texts:
        r, n = line_features(t)
        rows += r
        lengths += n
        counts.append(len(r))
    counts = np.array(counts, int)
    if not rows:
        return np.zeros(0), np.zeros(0), counts
    starts = np.cumsum(counts) - counts
    full = counts > 0
    x = (_matrix(np.array(rows), starts[full]) - np.array(model.mean)) / np.array(model.scale)
    pair = np.exp(np.array(model.transitions).reshape(2, 2))
    return _marginals(x @ np.array(model.weights), starts[full], counts[full], pair), np.array(lengths, float), counts


def line_chances(text: bytes, model: LineModel) -> np.ndarray:
    """The chance of being good of each line of a text that has a word."""
    return _good_lines([text], model)[0]


def score_texts(texts: list[bytes], model: LineModel) -> np.ndarray:
    good, lengths, counts = _good_lines(texts, model)
    out = np.full(len(texts), model.base)
    full = counts > 0
    if full.any():
        z = model.slope * _logit(_weighted(good, lengths, counts)[full]) + model.shift
        out[full] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def score(df: DataFrame, model: LineModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the chance (0 to 1) that each whole text is good.

    Null and empty texts, and texts of white space, get the base rate of the labels. Lines of any
    number are decoded together. An input column ``out`` is replaced.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        forget()
        texts = texts_of(batch, text)
        parts, at, size = [np.zeros(0)], 0, 0
        for i, t in enumerate(texts):  # some MB of text at a time
            size += len(t)
            if size > 8_000_000 or i == len(texts) - 1:
                parts.append(score_texts(texts[at : i + 1], model))
                at, size = i + 1, 0
        return [pa.array(np.concatenate(parts))]

    return add_columns(df, f"`{out}` double", make)
