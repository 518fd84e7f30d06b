"""Repetition inside a text by suffix arrays.

Texts are sequences of words. Neighbours in the suffix array of a text share its longest repeats; every
interval of common prefixes of at least n words is a maximal repeated substring, and all its occurrences are
covered. The longer the repeats, the less of a text their union may cover; the longest repeat has a limit too.

Many texts share one array: the first symbol of a suffix is told apart by text, so no repeat crosses
texts. Suffixes are ordered by doubling, and only those that still share a prefix with
another go on, so that clean text costs a few sorts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_columns, texts_of

#: Reject when repeats of at least so many words cover more hundredths of the words than this: the duplicate n-gram
#: limits of Rae et al., "Scaling language models" (2021), table A1; fixed values ...
MAX_COVERED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: ... or when one repeat is longer than so many words.
MAX_REPEAT = 50
#: Base rule: fewer words, or more hundredths of them in windows of WINDOW words found twice, fail.
MIN_WORDS, WINDOW, MAX_WINDOWED = 10, 5, 20

_SIGNS, _BLANK = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
#: Words of texts that share an array, about; a longer text has one of its own.
BATCH_WORDS = 400_000


def _runs(values: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, where its run of equal values starts."""
    at = np.arange(len(values))
    at[1:][values[1:] == values[:-1]] = 0
    return np.maximum.accumulate(at)


def longest_repeats(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that occurs elsewhere in its text.

    ``symbols`` are word numbers of texts laid end to end, ``starts`` the first position of each text
    (none empty). The length is the larger common prefix with the two neighbours in the suffix array.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    sizes = np.diff(np.append(starts, n))
    left = np.repeat(np.append(starts[1:], n), sizes) - np.arange(n)  # words to the text's end
    # rank: how many suffixes come before the group of those that agree in text and the first ``width`` words.
    keys = np.repeat(np.arange(len(starts)), sizes) * (int(symbols.max()) + 1) + symbols
    tied, base, width = np.arange(n), np.zeros(n, np.int64), 1
    rank, levels = np.zeros(n, np.int64), []
    while True:
        order = np.argsort(base * (n + 2) + keys if width > 1 else keys, kind="stable")
        tied, keys, base = tied[order], keys[order], base[order]
        first = _runs(base * (n + 2) + keys if width > 1 else keys)
        rank[tied] = base + first - (_runs(base) if width > 1 else 0)
        levels.append(rank.astype(np.int32))
        many = np.zeros(len(tied), bool)
        many[1:] = first[1:] == first[:-1]
        many[:-1] |= many[1:]
        if not many.any():
            break
        tied = tied[many]
        base = rank[tied]
        # What follows the first ``width`` words; a suffix that ends there comes first.
        keys = np.where(left[tied] > width, rank[np.minimum(tied + width, n - 1)] + 1, 0)
        width *= 2
    # Suffixes that share their first word with another, in suffix order; common prefixes of neighbours
    # by steps of falling powers of two, for which groups agree exactly if the words do.
    order = np.argsort(rank, kind="stable")
    first = levels[0][order]
    near = np.flatnonzero(first[1:] == first[:-1])
    a, b = order[near], order[near + 1]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = (common + step <= left[a]) & (common + step <= left[b])
        agree = levels[k][np.minimum(a + common, n - 1)] == levels[k][np.minimum(b + common, n - 1)]
        common += np.where(fits & agree, step, 0)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def repetition(texts: list[bytes], lengths: Sequence[int] = tuple(MAX_COVERED), window: int = WINDOW) -> list[tuple]:
    """(words, words in repeats of at least n words for each n of ``lengths``, longest repeat, words in repeated windows) of each text."""
    out, batch, size = [], [], 0
    for text in texts:
        batch.append(text.split())
        size += len(batch[-1])
        if size >= BATCH_WORDS:
            out += _repetition(batch, lengths, window)
            batch, size = [], 0
    return out + (_repetition(batch, lengths, window) if batch else [])


def _covered(lengths: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Covered positions of each text; the spans start at every position and are ``lengths`` long."""
    n = len(lengths)
    at = np.flatnonzero(lengths)
    change = np.zeros(n + 1, np.int64)
    change[at] += 1
    np.subtract.at(change, at + lengths[at], 1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return inside[ends] - inside[starts]


def _repetition(batch: list[Sequence], lengths: Sequence[int], window: int) -> list[tuple[int, tuple[int, ...], int, int]]:
    sizes = np.array([len(w) for w in batch])
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    number = defaultdict(count().__next__)
    symbols = np.fromiter((number[w] for words in batch for w in words), np.int64, int(sizes.sum()))
    full = sizes > 0
    repeats = longest_repeats(symbols, starts[full])
    covered = [_covered(np.where(repeats >= n, repeats, 0), ends, starts).tolist() for n in lengths]
    windowed = _covered(np.where(repeats >= window, window, 0), ends, starts)
    longest = np.zeros(len(batch), np.int64)
    if full.any():
        longest[full] = np.maximum.reduceat(repeats, starts[full])
    return list(zip(sizes.tolist(), zip(*covered), longest.tolist(), windowed.tolist()))


def rate(
    df: DataFrame, text: str = "text", max_covered: Mapping[int, int] = MAX_COVERED, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """Add counts, ``longest_repeat``, ``failed_length``, ``base_failed`` and ``kept`` for every whole text.

    Counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. failed_length: the least repeat length of
    ``max_covered`` whose limit (in hundredths of the words) the text passes, null if none. Kept is what passes
    neither the base rule, nor such a limit, nor ``max_repeat``. Null and empty texts have zero of everything, fail the
    base rule and are not kept. Rows, repeated ones too, stay as they are; input columns of the same names are replaced.
    """
    lengths = sorted(max_covered)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = texts_of(batch, text)
        rows = []
        for t, (n, covered, longest, windowed) in zip(texts, repetition(texts, lengths)):
            lines = [x for x in t.split(b"\n") if x.strip(_BLANK)]
            solid = t.translate(None, _BLANK)
            failed = n < MIN_WORDS or 100 * windowed > MAX_WINDOWED * n
            over = next((k for k, c in zip(lengths, covered) if 100 * c > max_covered[k] * n), None)
            rows.append((
                n, len(solid.decode("utf-8", "replace")), len(t) - len(t.translate(None, _SIGNS)), len(lines) - len(set(lines)),
                windowed, longest, over, failed, not failed and over is None and longest <= max_repeat,
            ))
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.bool_()]
        columns = list(zip(*rows)) or [()] * len(kinds)
        return [pa.array(c, k) for c, k in zip(columns, kinds)]

    return add_columns(
        df,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "longest_repeat long, failed_length long, base_failed boolean, kept boolean",
        make,
    )
