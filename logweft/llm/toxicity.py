"""Toxicity of texts whose insults may be disguised: noisy-channel restoring, then scoring.

Every word that shows noise (digits or signs among letters, letters repeated) and every run of short pieces is a
lattice of readings: a sign stands for a letter or for nothing, a repeated letter counts or not, a gap between
pieces parts two words or is dropped. The most likely reading under a character trigram model of the whole
corpus is found by Viterbi decoding. The restored words and their beginnings, weighted by how often labelled documents with them are
toxic, give the score.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import _Memory
from .common import MEMORIES, add_columns, forget, texts_of

#: Labelled documents that the words are weighted on, at most; taken in the order of a hash of their ids.
TRAIN_DOCS = 30_000
#: Documents with a word count as so many more documents of the average toxicity.
PRIOR_DOCS = 4.0
#: Beginnings of these lengths stand for families of words.
PREFIXES = (4, 5, 6, 7, 8)
#: A word is weighted if at least so many toxic documents have it.
LEAST_DOCS = 4
#: A word is kept if it is the most telling one of at least so many toxic documents.
LEAST_TOLD = 2
#: Its weight then has so many documents of the average toxicity added, instead of PRIOR_DOCS.
SURE_DOCS = 1.5

#: Distinct words that a worker remembers if it is asked for no other number; the memory is emptied when full.
MEMORY = 200_000

# What signs commonly stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h",
}
# Log-probabilities of the channel. A letter of the model costs about two, so that a sign must be much likelier
# to stand for a letter than for nothing, or the reading with fewer letters would always win.
AS_IT_IS, UNDOUBLED = math.log(0.9), math.log(0.3)
READ_AS, DIGIT_DROPPED, SIGN_DROPPED = math.log(0.5), math.log(0.00001), math.log(0.01)
#: A gap (dropped, kept) between single characters, between longer pieces, and a mark inside a word.
GAPS = {" ": (math.log(0.8), math.log(0.2)), "\n": (math.log(0.1), math.log(0.9))}
MARK = (math.log(0.5), math.log(0.3))

LETTERS = 28  # a-z, other bytes of letters, space
_STATES = LETTERS * LETTERS
OTHER, SPACE = 26, 27
_CLASS = np.full(256, SPACE, np.uint8)
_CLASS[128:] = OTHER
_CLASS[ord("a") : ord("z") + 1] = np.arange(26)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(26)
_CLASSES = _CLASS.tobytes()

_EDGES = b".,;:!?\"'()[]{}<>*#%&$|~^`/\\=+-_"
_NOISE = re.compile(rb"[a-z\x80-\xff][^a-z\x80-\xff]|[^a-z\x80-\xff][a-z\x80-\xff]|([a-z])\1")
# Pieces of at most four characters with white space or marks between them.
_PIECE = rb"(?:[a-z0-9@$!]|[\xc2-\xf4][\x80-\xbf]{1,3}){1,4}+(?![a-z0-9@$!\x80-\xff])"
_PIECES = re.compile(rb"(?<![a-z0-9@$!\x80-\xff])" + _PIECE + rb"(?:[\s.,;:?\"'()\[\]{}<>*#%&|~^`/\\=+_-]++" + _PIECE + rb")+")
_GAP = re.compile(rb"[^a-z0-9@$!\x80-\xff]+")
_DOUBLED = re.compile(rb"([a-z])\1")

# How two neighbouring pieces are read, by the last two letters of one and the first two of the other. Pieces with other characters
# or double letters are decoded, single characters have no neighbours.
_PAIRS = 26 * 26
_DECODED, _SINGLE, _CODES = _PAIRS, _PAIRS + 1, _PAIRS + 2
APART, JOINED, OPEN = 0, 1, 2


# ------------------------------------------------------------------ character model


def character_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts by character class: at most 28^3 numbers, whatever the input."""

    def run(batches):
        forget()
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            part, size = [], 0
            for t in [*texts_of(batch, text), None]:  # a few MB at a time: counting takes 8 bytes a letter
                if part and (t is None or size > 4_000_000):
                    data = b"  " + b"  ".join(part) + b"  "
                    c = np.frombuffer(data.translate(_CLASSES), np.uint8).astype(np.uint16)
                    code = c[:-2] * np.uint16(LETTERS * LETTERS) + c[1:-1] * np.uint16(LETTERS) + c[2:]
                    total += np.bincount(code, minlength=LETTERS**3)
                    part, size = [], 0
                if t is not None:
                    part.append(t)
                    size += len(t)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, "code long, n long")
    counts = np.zeros(LETTERS**3, np.int64)
    for code, n in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most 28^3 rows
        counts[code] = n
    return counts


def character_model(counts: np.ndarray) -> list[float]:
    """Log-probability of the third class after the first two, smoothed with the bigram and the unigram."""
    tri = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + LETTERS)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    return np.log(p3).ravel().tolist()


def readings(c: str, last: str) -> list[tuple[str, float]]:
    """What ``c`` after ``last`` may stand for, with the channel's log-probability: a letter, a space or nothing."""
    if c in LEET:
        letters = LEET[c]
        return [(x, READ_AS - math.log(len(letters))) for x in letters] + [("", DIGIT_DROPPED if c.isdigit() else SIGN_DROPPED)]
    if c.isalpha():
        return [(c, AS_IT_IS)] + ([("", UNDOUBLED)] if c == last else [])
    dropped, kept = GAPS.get(c, MARK)
    return [("", dropped), (" ", kept)]


@functools.lru_cache(maxsize=4096)
def _arcs(c: str, last: str) -> list[tuple[str, int, float]]:
    """``readings`` with the class of each letter."""
    return [(x, SPACE if x == " " else ord(x) - 97 if "a" <= x <= "z" else OTHER, cost) for x, cost in readings(c, last)]


def viterbi(word: str, model: list[float]) -> str:
    """The likeliest reading of ``word`` (lower case), words parted by spaces. States are the last two letters; O(length)."""
    key, score, path = SPACE * LETTERS + SPACE, 0.0, ()
    states: dict[int, tuple[float, tuple]] = {}  # empty while there is but one state, which the three above are
    last = ""
    for c in word:
        arcs = _arcs(c, last)
        last = c
        if len(arcs) == 1 and not states:  # a letter that stands for itself
            letter, k, cost = arcs[0]
            at = key * LETTERS + k
            key, score, path = at % _STATES, score + cost + model[at], (path, letter)
            continue
        after: dict[int, tuple[float, tuple]] = {}
        for key, (score, path) in states.items() if states else ((key, (score, path)),):
            for letter, k, cost in arcs:
                if letter:
                    at = key * LETTERS + k
                    to, value, way = at % _STATES, score + cost + model[at], (path, letter)
                else:
                    to, value, way = key, score + cost, path
                if to not in after or value > after[to][0]:
                    after[to] = (value, way)
        states = after
        if len(states) == 1:
            (key, (score, path)), = states.items()
            states = {}
    best = path
    if states:
        best = max(states.items(), key=lambda s: (s[1][0] + model[s[0] * LETTERS + SPACE], s[0]))[1][1]
    out = []
    while best:
        best, letter = best
        out.append(letter)
    return "".join(reversed(out))


def _neighbours(model: list[float]) -> bytes:
    """For each end of a piece and beginning of the next whether ``viterbi`` drops the gap (``JOINED``) or keeps it (``APART``).

    Both ways part at the gap and are in one state again two letters later, so that these four letters tell. ``OPEN``: too close to tell
    by sums in another order, or a piece that is to be decoded.
    """
    m = np.array(model).reshape(LETTERS, LETTERS, LETTERS)
    letters, (dropped, kept) = m[:26, :26, :26], GAPS["\n"]
    join = dropped + letters[:, :, :, None] + letters[None]  # x y | z w: z after x y, w after y z
    part = kept + m[:26, :26, SPACE][:, :, None, None] + m[:26, SPACE, :26][None, :, :, None] + m[SPACE, :26, :26][None, None]
    table = np.full((_CODES, _CODES), OPEN, np.uint8)
    told = np.where(join > part, JOINED, APART)
    told[np.abs(join - part) < 1e-9] = OPEN
    table[:_PAIRS, :_PAIRS] = told.reshape(_PAIRS, _PAIRS)
    table[_SINGLE], table[:, _SINGLE] = APART, APART
    return table.tobytes()


def _piece(raw: bytes) -> tuple[bytes, int, int, int]:
    """(piece, its characters, place of its end and of its beginning in the table of neighbours)."""
    piece = raw.rstrip(b"!$@") or raw[:1]
    n = len(piece) if piece.isascii() else len(piece.decode("utf-8", "replace"))
    if n < 2:
        return piece, n, _SINGLE * _CODES, _SINGLE
    if not piece.isalpha() or _DOUBLED.search(piece):
        return piece, n, _DECODED * _CODES, _DECODED
    a, b, y, z = piece[0] - 97, piece[1] - 97, piece[-2] - 97, piece[-1] - 97
    return piece, n, (y * 26 + z) * _CODES, a * 26 + b


class Restorer:
    """Restored words, each distinct one decoded once."""

    def __init__(self, model: list[float], remembered: int = MEMORY):
        self.model = model
        self.words = _Memory(self.word, remembered)
        self.runs = _Memory(self.run, remembered)
        self.pieces = _Memory(_piece, remembered // 4)
        self.neighbours = _neighbours(model)

    def word(self, raw: bytes) -> tuple[str, ...]:
        """The readings of a word between white space. One that merely has a double letter is also read as written."""
        core = raw.rstrip(_EDGES)
        plain = core.lstrip(_EDGES)
        if plain.isalpha() and not _DOUBLED.search(plain) and len(plain) == len(core):
            return (plain.decode(),)
        lead = core[: len(core) - len(plain)]
        if lead in (b"$", b"@", b"!", b"|") and len(plain) > 2:
            plain = lead + plain  # one sign before letters may be a letter
        text = plain.decode("utf-8", "replace")
        if not (_NOISE.search(plain) and any(map(str.isalpha, text))):
            return (text,) if text else ()
        found = viterbi(text, self.model).split(" ")
        return tuple({w for w in ([text, *found] if text.isalpha() else found) if w})

    def run(self, joined: bytes) -> tuple[str, ...]:
        """The words, of a run of pieces parted by gaps, that its likeliest reading makes of several pieces."""
        text = joined.decode("utf-8", "replace")
        return tuple(set(viterbi(text, self.model).split(" ")) - set(re.split("[ \n]", text)) - {""})

    def spaced(self, low: bytes) -> set[str]:
        """Words of a lower-case text that were written in pieces.

        Runs of three or more pieces of up to three characters, one of them single, are decoded whole; of other
        pieces every two neighbours, which is how a word falls into two.
        """
        found: set[str] = set()
        piece_of, neighbours = self.pieces.__getitem__, self.neighbours
        for m in _PIECES.finditer(low):
            pieces = list(map(piece_of, _GAP.split(m[0])))
            single = False
            end, before = _SINGLE * _CODES, b""
            for piece, n, after, start in pieces:
                if how := neighbours[end + start]:
                    if how == JOINED:
                        found.add((before + piece).decode())
                    else:
                        found.update(self.runs[before + b"\n" + piece])
                end, before = after, piece
                if n == 1:
                    single = True
            if single and len(pieces) > 2:
                run: list[tuple[bytes, int]] = []
                for piece, n, _, _ in [*pieces, (b"", 0, 0, 0)]:
                    if 0 < n < 4:
                        run.append((piece, n))
                        continue
                    if len(run) > 2:
                        found |= self._short(run)
                    run = []
        return found

    def _short(self, run: list[tuple[bytes, int]]) -> set[str]:
        found: set[str] = set()
        if not any(n == 1 for _, n in run):
            return found
        joined = run[0][0]
        for (_, before), (piece, n) in zip(run, run[1:]):
            joined += (b" " if before == n == 1 else b"\n") + piece
        found.update(self.runs[joined])
        # A word of one letter beside the spaced letters looks like one of them: read them without the first or last too.
        for single, letters in itertools.groupby(run, lambda x: x[1] == 1):
            letters = [c for c, _ in letters]
            if single and len(letters) > 3:
                for part in (letters, letters[1:], letters[:-1]):
                    found.update(self.runs[b" ".join(part)])
        return found

    def of(self, text: bytes) -> set[str]:
        """The distinct restored words of a text."""
        low = text.lower()
        found = self.spaced(low)
        for raw in set(low.split()):
            found.update(self.words[raw])
        found.discard("")
        return found


# ------------------------------------------------------------------ learning and scoring


@dataclass(frozen=True)
class ToxicityModel:
    characters: tuple[float, ...]
    weights: dict[str, float]  # word, or beginning with a trailing *: chance that a document with it is toxic
    base: float  # chance without any of them


def fit(
    docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_column: str = "doc_id", text: str = "text", remembered: int = MEMORY
) -> ToxicityModel:
    """Fit on the labelled rows given (``id_column``, toxic); the character model on all texts.

    Rows with a null id or label teach nothing; a document labelled twice counts as toxic if one label says
    so. At most ``train_docs`` labelled documents are used, with their whole texts. Without any
    toxic document every score is the base. ``remembered`` bounds each memory of a worker; results do not depend on it.
    """
    characters = character_model(character_counts(docs, text))
    sample = (
        labels.select(F.col(f"`{id_column}`").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(train_docs)
    )
    taught = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(
        F.broadcast(sample), "id"  # at most train_docs rows
    )

    def run(batches):
        restorer = _restorer(tuple(characters), remembered)
        counts = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(texts_of(batch), batch.column(1).to_pylist()):
                counts[y > 0].update(restorer.of(t))
                counts[y > 0][""] += 1  # the documents themselves
            if sum(map(len, counts)) > 300_000:
                yield _flush(counts)
        restorer.words.clear()  # the worker lives on
        restorer.runs.clear()
        yield _flush(counts)

    words = taught.select("text", "toxic").mapInArrow(run, "word string, toxic long, clean long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    starts = [
        F.when(F.length("word") >= n, F.struct(F.concat(F.substring("word", 1, n), F.lit("*")).alias("feature"), "toxic", "clean"))
        for n in PREFIXES
    ]
    features = (
        words.select(F.explode(F.array_compact(F.array(F.struct(F.col("word").alias("feature"), "toxic", "clean"), *starts))).alias("f"))
        .select("f.*").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    total = words.filter("word = ''").first()
    n_toxic, n_clean = (total["toxic"], total["clean"]) if total else (0, 0)
    rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    chance = (F.col("toxic") + PRIOR_DOCS * rate) / (F.col("toxic") + F.col("clean") + PRIOR_DOCS)
    # Less than twice the average says nothing. What is collected is bounded by the words of train_docs documents.
    kept = (
        features.filter((F.col("feature") != "") & (F.col("toxic") >= LEAST_DOCS) & (chance > min(2 * rate, 0.5)))
        .select("feature", chance.alias("p"), "toxic", "clean")
        .collect()
    )
    telling = _telling(taught, {r["feature"]: r["p"] for r in kept}, tuple(characters), remembered)
    weights = {
        r["feature"]: (r["toxic"] + SURE_DOCS * rate) / (r["toxic"] + r["clean"] + SURE_DOCS) for r in kept if r["feature"] in telling
    }
    return ToxicityModel(tuple(characters), weights, min(rate / 2, 0.25))


def _telling(taught: DataFrame, candidates: dict[str, float], characters: tuple[float, ...], remembered: int = MEMORY) -> set[str]:
    """The candidates that are the most telling word of at least ``LEAST_TOLD`` toxic documents.

    Words that merely stand beside an insult, in many copies of one text or as another word's beginning,
    are never that and go.
    """

    def run(batches):
        restorer, counts = _restorer(characters, remembered), Counter()
        for batch in batches:
            for t, y in zip(texts_of(batch), batch.column(1).to_pylist()):
                if y > 0:
                    found = [f for w in restorer.of(t) for f in features_of(w) if f in candidates]
                    if found:
                        counts[max(found, key=lambda f: (candidates[f], f))] += 1
        restorer.words.clear()
        restorer.runs.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    rows = taught.filter("toxic > 0").select("text", "toxic").mapInArrow(run, "feature string, n long")
    found = rows.groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most one row a toxic document
    return {f for f, n in found if n >= LEAST_TOLD}


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]


def _flush(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    words = list(set(counts[0]) | set(counts[1]))
    out = [pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in (counts[1], counts[0])]]
    for c in counts:
        c.clear()
    return pa.RecordBatch.from_arrays(out, names=["word", "toxic", "clean"])


@functools.lru_cache(maxsize=1)
def _restorer(characters: tuple[float, ...], remembered: int = MEMORY) -> Restorer:
    forget()
    return Restorer(list(characters), remembered)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score", remembered: int = MEMORY) -> DataFrame:
    """Add the chance (0 to 1) that each whole text is toxic: that of its most telling restored word.

    Empty and null texts, and texts without telling words, get the base. An input column ``out`` is replaced. For ``remembered`` see ``fit``.
    """
    characters, weights, base = model.characters, model.weights, model.base

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        scorer = _scorer(characters, base, tuple(weights.items()), remembered)
        return [pa.array([scorer(t) for t in texts_of(batch, text)], pa.float64())]

    return add_columns(df, f"`{out}` double", make)


@functools.lru_cache(maxsize=1)
def _scorer(characters: tuple[float, ...], base: float, items: tuple[tuple[str, float], ...], remembered: int = MEMORY):
    forget()
    restorer, weights = Restorer(list(characters), remembered), dict(items)
    heads = {f[: PREFIXES[0]] for f in weights}  # words that begin otherwise have no weight, nor have their beginnings

    def weigh(word: str) -> float:
        if word[: PREFIXES[0]] not in heads:
            return base
        return max([weights.get(f, base) for f in features_of(word)])

    chances = _Memory(lambda raw: max(map(weigh, restorer.word(raw)), default=base), remembered)

    def scored(text: bytes) -> float:
        low = text.lower()
        best = max(map(chances.__getitem__, set(low.split())), default=base)
        return max(best, max(map(weigh, restorer.spaced(low)), default=base))

    return scored


MEMORIES += [_restorer.cache_clear, _scorer.cache_clear]
