"""Runs (stretches of words that repeat with a period) of whole texts, by grammar compression.

Re-Pair: the pair of neighbouring symbols that occurs most often becomes a rule and is replaced wherever it
stands, until no pair of a text occurs twice. A round takes all pairs at once that occur more often than the
pairs they overlap with, since those do not touch each other. What is left is halved by rules that stand once, so
that every text is derived by binary rules; each replacement is a place (start, middle, end) of its rule.

A run lies in the smallest derived place that holds it, and there it crosses the middle. So each rule is looked at
once, at its first place: a run across the middle has one whole period on one of its sides, hence a word that
equals the one a period away next to the middle. The found runs are moved to all other places of the rule, and
overlapping pieces of one period are united; the longest piece is the maximal run.

Many texts share the arrays, but words are numbered by text, so that no rule and no run crosses texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns, crc32_text, texts_of

#: A run is at least so many words and so many periods long.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: Words of texts that share the arrays, about; a longer text has them to itself.
BATCH_WORDS = 200_000
#: Candidate periods compared at once.
BATCH_PERIODS = 500_000


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all integers of the ranges [low, high), range by range."""
    sizes = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), sizes)
    first = np.cumsum(sizes) - sizes
    return owner, low[owner] + np.arange(len(owner)) - first[owner]


def grammar(symbols: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, middle, end) of every place at which a rule is derived, in positions of ``symbols``.

    ``symbols`` are word numbers, ``texts`` the text of each word (ascending); no word number occurs in two texts.
    """
    n = len(symbols)
    places: list[tuple[np.ndarray, ...]] = []
    start, end = np.arange(n), np.arange(1, n + 1)
    symbol, text = symbols.astype(np.int64), texts
    rules = int(symbol.max()) + 1 if n else 0
    done: list[tuple[np.ndarray, ...]] = []  # what is left of texts without a pair that occurs twice

    def replace(at: np.ndarray, rule: np.ndarray) -> None:
        nonlocal symbol, start, end, text
        places.append((rule, start[at], end[at], end[at + 1]))
        symbol, end = symbol.copy(), end.copy()
        symbol[at], end[at] = rule, end[at + 1]
        stays = np.ones(len(symbol), bool)
        stays[at + 1] = False
        symbol, start, end, text = symbol[stays], start[stays], end[stays], text[stays]

    while len(symbol) > 1:
        same = text[1:] == text[:-1]
        pair = np.where(same, symbol[:-1] * rules + symbol[1:], -1)
        # Of overlapping equal pairs (a a a) every second one counts, from the left.
        again = np.zeros(len(pair), bool)
        again[1:] = (pair[1:] == pair[:-1]) & same[1:]
        at = np.arange(len(pair))
        usable = same & ((at - np.maximum.accumulate(np.where(again, 0, at))) % 2 == 0)
        kinds, which, counts = np.unique(pair[usable], return_inverse=True, return_counts=True)
        often = np.full(len(pair) + 2, -1)  # with a border on both sides
        often[1:-1][usable] = np.where(counts > 1, counts * len(kinds) + np.arange(len(kinds)), -1)[which]
        own = often[1:-1]
        live = np.zeros(int(text[-1]) + 1, bool)
        live[text[:-1][own >= 0]] = True
        if not live.all():  # texts that have ended leave the rounds
            over = ~live[text]
            if over.any():
                done.append((symbol[over], start[over], end[over], text[over]))
                symbol, start, end, text = symbol[~over], start[~over], end[~over], text[~over]
                continue
        best = np.flatnonzero((own >= 0) & (own > often[:-2]) & (own > often[2:]))
        replace(best, rules + own[best] % len(kinds))
        rules += len(kinds)
    if done:
        symbol, start, end, text = (np.concatenate(x) for x in zip(*done, (symbol, start, end, text)))
        order = np.argsort(start)
        symbol, start, end, text = symbol[order], start[order], end[order], text[order]
    while True:
        first = np.searchsorted(text, text)  # where the text begins
        at = np.arange(len(text))
        last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
        at = at[((at - first) % 2 == 0) & ~last]
        if not len(at):
            break
        replace(at, rules + np.arange(len(at)))
        rules += len(at)
    if not places:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*places))


class _Common:
    """Names of the substrings of 1, 2, 4, ... words, equal if the words are; -1 - position for one that stands once."""

    def __init__(self, symbols: np.ndarray, texts: np.ndarray):
        n = len(symbols)
        self.levels = [symbols.astype(np.int64)]
        live, width = np.arange(n), 1
        while len(live):
            live = live[live + width < n]
            name = self.levels[-1]
            a, b = name[live], name[live + width]
            fits = (a >= 0) & (b >= 0) & (texts[live] == texts[np.minimum(live + 2 * width - 1, n - 1)]) & (live + 2 * width <= n)
            live = live[fits]
            _, first, which, counts = np.unique(
                a[fits] * (n + 1) + b[fits], return_index=True, return_inverse=True, return_counts=True
            )
            many = counts[which] > 1
            if not many.any():
                break
            name = -1 - np.arange(n)
            name[live[many]] = live[first[which[many]]]  # the first such position
            live = live[many]
            self.levels.append(name)
            width *= 2

    def after(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and from ``b`` on, ``most`` at most."""
        return self._equal(a, b, most, 1)

    def before(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words before ``a`` and before ``b``, ``most`` at most."""
        return self._equal(a, b, most, -1)

    def _equal(self, a, b, most, way):
        out = np.zeros(len(a), np.int64)
        top = len(self.levels) - 1
        for k in [top] + list(range(top, -1, -1)):
            step, name = 1 << k, self.levels[k]
            going = np.arange(len(out))
            while True:  # the longest step may be taken more than once, shorter ones not
                going = going[out[going] + step <= most[going]]
                shift = out[going] if way > 0 else -out[going] - step
                going = going[name[a[going] + shift] == name[b[going] + shift]]
                out[going] += step
                if k < top or not len(going):
                    break
        return out


def _three(symbols: np.ndarray, texts: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the three words at each position, or -1 - position; the sorted number * n + position)."""
    n = len(symbols)
    three = -1 - np.arange(n)
    at = np.flatnonzero((pairs[: max(n - 2, 0)] >= 0) & (texts[: max(n - 2, 0)] == texts[2:]))
    found, which = np.unique(pairs[at] * (n + 1) + symbols[at + 2], return_inverse=True)
    three[at] = which
    return three, np.sort(three[at] * n + at)


def _crossing(common: _Common, three, index, n: int, rule, start, middle, end, least: int) -> list[np.ndarray]:
    """[rule number, start, end, period] of the runs, and longer periods of the same, across the middles."""
    # Either three words from the middle on, or three before it, are equal to those a period to the right or left.
    asks = []
    for shift, right in ((0, True), (-3, True), (0, False), (-3, False)):
        at = middle + shift
        ok = (at >= start) & (at + 3 <= end)
        value = np.where(ok, three[np.clip(at, 0, n - 1)], -1)
        ok &= value >= 0
        who, at, value = np.flatnonzero(ok), at[ok], value[ok]
        if right:
            low, high = np.searchsorted(index, value * n + at, "right"), np.searchsorted(index, value * n + end[who] - 3, "right")
        else:
            low, high = np.searchsorted(index, value * n + start[who]), np.searchsorted(index, value * n + at)
        asks.append((who, at, low, high, right))
    out = []
    for who, at, low, high, right in asks:
        sizes = np.cumsum(np.maximum(high - low, 0))
        first = 0
        while first < len(who):
            stop = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BATCH_PERIODS)))
            owner, where = _expand(low[first:stop], high[first:stop])
            owner += first
            period = np.abs(index[where] % n - at[owner])
            w = who[owner]
            b, s, e = middle[w], start[w], end[w]
            if right:  # a whole period right of the middle
                ok = b + period <= e
                w, b, s, e, period = w[ok], b[ok], s[ok], e[ok], period[ok]
                left, onward = common.before(b, b + period, b - s), common.after(b, b + period, e - b - period)
                lo, hi = b - left, b + period + onward
            else:
                ok = b - period >= s
                w, b, s, e, period = w[ok], b[ok], s[ok], e[ok], period[ok]
                left, onward = common.before(b - period, b, b - period - s), common.after(b - period, b, e - b)
                lo, hi = b - period - left, b + onward
            ok = hi - lo >= np.maximum(least, LEAST_PERIODS * period)
            out.append(np.stack([rule[w[ok]], lo[ok], hi[ok], period[ok]], axis=1))
            first = stop
    return out


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted rows, the smallest last value of each of the others."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
    return rows[new]


def find_runs(symbols: np.ndarray, texts: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """[start, end, period] of all runs of at least ``least`` words (6 or more), by start, end.

    A run has its smallest period, is at least two periods long and can't be extended. The arguments are those of ``grammar``.
    """
    n, nothing = len(symbols), np.zeros((0, 3), np.int64)
    if least < 6:
        raise ValueError("shorter runs do not hold three equal words beside the middle")
    if n < least:
        return nothing
    rule, start, middle, end = grammar(symbols, texts)
    wide = np.flatnonzero(end - start >= least)
    rule, start, middle, end = rule[wide], start[wide], middle[wide], end[wide]
    common = _Common(symbols, texts)
    if not len(rule) or len(common.levels) < 2:
        return nothing
    # Each rule once, at its first place.
    order = np.lexsort((start, rule))
    rule, start, middle, end = rule[order], start[order], middle[order], end[order]
    first = np.flatnonzero(np.append(True, rule[1:] != rule[:-1]))
    three, index = _three(symbols, texts, common.levels[1])
    number = np.arange(len(first))
    found = _crossing(common, three, index, n, number, start[first], middle[first], end[first], least)
    found = _distinct(np.concatenate([np.zeros((0, 4), np.int64), *found]))
    # To all places of the rule.
    many = np.diff(np.append(first, len(rule)))
    owner, place = _expand(first[found[:, 0]], first[found[:, 0]] + many[found[:, 0]])
    moved = (start[place] - start[first[found[owner, 0]]])[:, None]
    pieces = np.column_stack([found[owner, 3], found[owner, 1:3] + moved])
    pieces = pieces[np.lexsort((-pieces[:, 2], pieces[:, 1], pieces[:, 0]))]
    # Pieces of one period that share a whole period are one run.
    period, lo, hi = pieces.T
    if not len(pieces):
        return nothing
    block = np.cumsum(np.append(False, period[1:] != period[:-1]))
    reach = np.maximum.accumulate(hi + block * (n + 1)) - block * (n + 1)
    new = np.append(True, (period[1:] != period[:-1]) | (lo[1:] + period[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    whole = np.column_stack([lo[at], np.maximum.reduceat(hi, at), period[at]])
    return _distinct(whole)


def _number(texts: list[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers that differ between texts, and the text of each word."""
    sizes = np.array([len(w) for w in texts])
    text = np.repeat(np.arange(len(texts)), sizes)
    words = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy()
    numbers = np.unique(text * (int(words.max()) + 1) + words, return_inverse=True)[1] if len(words) else words.astype(np.int64)
    return numbers, text


def runs_of(texts: Iterable[list[bytes]], least: int = LEAST_WORDS) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Each text (its words) with [start, length, period] of its runs, by start, then period. Holds a batch at a time."""
    batch, size = [], 0
    for words in texts:
        batch.append(words)
        size += len(words)
        if size >= BATCH_WORDS:
            yield from zip(batch, _runs_of(batch, least))
            batch, size = [], 0
    if batch:
        yield from zip(batch, _runs_of(batch, least))


def _runs_of(batch: list[list[bytes]], least: int) -> list[np.ndarray]:
    sizes = np.array([len(w) for w in batch])
    ends = np.cumsum(sizes)
    found = find_runs(*_number(batch), least)
    whose = np.searchsorted(ends, found[:, 0], "right")
    rows = np.column_stack([found[:, 0] - (ends - sizes)[whose], found[:, 1] - found[:, 0], found[:, 2]])
    order = np.lexsort((rows[:, 2], rows[:, 0], whose))
    rows, whose = rows[order], whose[order]
    cuts = np.searchsorted(whose, np.arange(len(batch) + 1))
    return [rows[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def collapsed(words: Sequence[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats: the first period of a run stays unless another run drops it."""
    if not len(runs):
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def with_planted_period(words: list[bytes], number: int) -> list[bytes]:
    """For a tenth of the numbers the text from some word on is made periodic (a check of the whole path)."""
    n, g = len(words), number // 10
    if number % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect(df: DataFrame, text: str = "text", planted: str | None = None, least: int = LEAST_WORDS) -> DataFrame:
    """Add the number of runs of each whole text, its longest run, and digests of all runs and of the text without repeats.

    Words are separated by ASCII white space. The longest run is the first of equals, then that of the shorter period; without a
    run its four columns are null. Null and empty texts have no words, no runs and the digests of empty text.
    Rows, repeated ones too, stay where they are; input columns of the new names are replaced. ``planted`` names a
    column by whose crc32 some texts are made periodic before (``with_planted_period``; null counts as empty text).
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = (t.split() for t in texts_of(batch, text))
        if planted is not None:
            numbers = map(crc32_text, batch.column(batch.schema.get_field_index(planted)).to_pylist())
            texts = (with_planted_period(t, k) for t, k in zip(texts, numbers))
        rows = []
        for words, runs in runs_of(texts, least):
            lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs.tolist())
            start = length = period = milli = None
            if len(runs):
                start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
                milli = 1000 * length // period
            rest = b" ".join(collapsed(words, runs))
            rows.append((len(runs), start, length, period, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        return [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)]

    return add_columns(df, COLUMNS, make)
