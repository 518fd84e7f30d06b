"""BPE encoding by forced boundaries, and decoding.

A byte pair that no vocabulary token holds side by side can never be merged, so the text may be
cut there without looking further. The encoder cuts texts at white space and at the words of the
tokenizer's own pattern, then at every such pair, encodes what is new to a worker and
joins the results. The fragments of all new words of some texts are merged at the same time, in arrays.
Ids equal those of the tokenizers library with ``add_special_tokens=False``.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import MEMORIES, add_columns, forget, texts_of

END = "</w>"
NO_MERGE, FORCED = 1 << 40, 1 << 41

#: Fragments, words and chunks remembered by a worker if its operator asks for no other number; a memory that is full is emptied, but for
#: what is wanted now if that is known.
CACHE_SIZE = 400_000

#: Bytes of texts that are taken together, about, and words merged at the same time; words of more than ``LONG_WORD`` bytes,
#: and few words, are merged by themselves.
AT_ONCE, WORDS_AT_ONCE, LONG_WORD, FEW_WORDS = 4 << 20, 1 << 15, 60, 200
#: Texts whose ids are joined together.
SOME_TEXTS = 128

# Words of plain chunks, in the tokenizer's own pattern; all other texts go through the library's own steps.
_OWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = regex.compile(_OWN_PATTERN)
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
# Below this letter there are no combining marks, and lower case needs no context.
_FIRST_MARK = "\u0250"
# Chunks that are surely below it and hold no special token.
_NOT_PLAIN = re.compile(rb"[\xc9-\xff]|<\|")


def _keep(memory: dict, wanted: Iterable) -> None:
    """Forget all but what is wanted now."""
    known = {k: memory[k] for k in wanted if k in memory}
    memory.clear()
    memory.update(known)


@functools.lru_cache(maxsize=1)
def _plain_words() -> Callable[[str], list[str]]:
    """The words of a chunk without ``_NOT_PLAIN``, in lower case; what the own pattern finds, told by lists of letters."""
    low = sorted({c for i in range(ord(_FIRST_MARK)) for c in chr(i).lower()})
    kinds = ["".join(re.escape(c) for c in low if regex.fullmatch(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s")]
    letters, numbers, spaces = kinds
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall


def _byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class _Memory(dict):
    """Remembers what ``make`` returned for a key."""

    def __init__(self, make, size: int = CACHE_SIZE):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.size:
            self.clear()
        self[key] = value
        return value


class _Merges:
    """The merges and the pairs inside tokens as arrays, and many words merged by them at the same time."""

    NONE = np.int64(1) << 62  # above every rank and place
    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[str, int], rank: dict[tuple[str, str], int], inner: dict[tuple[str, str], int]):
        letters = _byte_letters()
        self.symbol = np.array([[vocab[letters[b] + end] for b in range(256)] for end in ("", END)], np.int64)
        code = {letters[b] + end: b + 256 * n for n, end in enumerate(("", END)) for b in range(256)}
        # Rank of two neighbouring bytes, the second one perhaps a word's last.
        self.first = np.full((256, 512), FORCED, np.int64)
        for (left, right), r in inner.items():
            if code[left] < 256:
                self.first[code[left], code[right]] = r
        self.made = np.zeros(max(rank.values(), default=0) + 1, np.int64)
        for (left, right), r in rank.items():
            self.made[r] = vocab[left + right]
        # Pairs and their ranks in a table with linear probing; a free place holds -1.
        self.width = max(vocab.values()) + 1
        bits = max(18, (4 * len(rank)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_MERGE, np.int64)
        pairs = np.array([vocab[left] * self.width + vocab[right] for left, right in rank], np.int64)
        for at, pair, r in zip(self._place(pairs).tolist(), pairs.tolist(), rank.values()):
            while self.keys[at] >= 0:
                at = (at + 1) & (len(self.keys) - 1)
            self.keys[at], self.ranks[at] = pair, r

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * self._MIX) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, ``NO_MERGE`` if there is none."""
        pairs = left * self.width + right
        at = self._place(pairs)
        held, out = self.keys[at], self.ranks[at]
        open_ = np.flatnonzero((held != pairs) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[at[open_]]
            out[open_] = self.ranks[at[open_]]
            open_ = open_[(held != pairs[open_]) & (held >= 0)]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words, none empty. Each round merges the first pair of lowest rank in every fragment."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        last = np.zeros(len(data), np.int64)
        last[ends - 1] = 1
        token = self.symbol[last, data]
        rank = np.full(len(data), FORCED, np.int64)
        rank[:-1] = self.first[data[:-1], data[1:] + (last[1:] << 8)]
        rank[ends - 1] = FORCED
        start = np.flatnonzero(np.concatenate([[True], rank[:-1] == FORCED]))
        # A pair's key is its rank and its place, so that the least key is the first one of lowest rank.
        out, place = np.full(len(data), -1, np.int64), np.arange(len(data))
        key = np.where(rank < NO_MERGE, rank << 32 | place, self.NONE)
        while len(start):
            best = np.minimum.reduceat(key, start)
            size = np.diff(start, append=len(key))
            more = best < self.NONE
            if not more.all():  # ended fragments leave
                stay = np.repeat(more, size)
                out[place[~stay]] = token[~stay]
                token, place, key, size, best = token[stay], place[stay], key[stay], size[more], best[more]
                if not len(size):
                    break
                start = np.cumsum(size) - size
            at = np.searchsorted(place, best & 0xFFFFFFFF)
            token[at] = self.made[best >> 32]
            stay = np.ones(len(place), bool)
            stay[at + 1] = False
            token, place, key = token[stay], place[stay], key[stay]
            at -= np.arange(len(at))  # one token has left before each place, for every fragment before it
            start = start - np.arange(len(start))
            size = size - 1
            key[at] = self.NONE
            for i in (at[at > start] - 1, at[at < start + size - 1]):
                r = self.rank(token[i], token[i + 1])
                key[i] = np.where(r < NO_MERGE, r << 32 | place[i], self.NONE)
        kept = out >= 0
        ids = out[kept].astype("<u4").tobytes()
        to = (np.cumsum(kept)[ends - 1] * 4).tolist()
        return [ids[i:j] for i, j in zip([0, *to], to)]


class ForcedBoundaryBpe:
    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or _OWN_PATTERN not in json.dumps(
            spec["pre_tokenizer"], ensure_ascii=False
        ).replace("\\\\", "\\"):
            raise ValueError("a BPE vocabulary with word ends and the word pattern above is needed")
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.largest = max(self.tokens)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: n for n, pair in enumerate(merges)}
        # A symbol is a byte's letter, or the letter with the word end. Every token is made by merges,
        # so the pairs inside tokens are those where two parts of some merge touch.
        edge = {s: (s, s) for s in self._symbols()}
        # The value is the rank at which the two symbols merge by themselves.
        self.inner: dict[tuple[str, str], int] = {}
        for left, right in merges:
            pair = (edge[left][1], edge[right][0])
            self.inner[pair] = self.rank.get(pair, NO_MERGE)
            edge[left + right] = (edge[left][0], edge[right][1])
        self.letters = _byte_letters()
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.remembered = CACHE_SIZE if remembered is None else remembered
        self.fragments = _Memory(lambda symbols: self._merge(list(symbols)), self.remembered // 2)
        self.words = _Memory(self._word, self.remembered)
        self.chunks = _Memory(self._chunk, self.remembered)
        # Words of plain chunks as they are, not in byte letters.
        self.plain: dict[str, bytes] = {}
        self.merges = _Merges(self.vocab, self.rank, self.inner)

    @staticmethod
    def _symbols() -> list[str]:
        letters = list(_byte_letters().values())
        return letters + [c + END for c in letters]

    def forced(self, left: str, right: str) -> bool:
        """Whether no token holds these neighbouring symbols."""
        return (left, right) not in self.inner

    def split(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Cut at the forced boundaries."""
        cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in self.inner]
        return [tuple(symbols[i:j]) for i, j in zip([0, *cuts], [*cuts, len(symbols)])]

    def _merge(self, parts: list[str], ranks: list[int] | None = None) -> bytes:
        """Ids of one fragment, packed: lowest rank first, leftmost first. O(n log n) in its length."""
        rank, n = self.rank, len(parts)
        if n <= 60:
            if ranks is None:
                ranks = [rank.get(pair, NO_MERGE) for pair in zip(parts, parts[1:])]
            while ranks and (best := min(ranks)) != NO_MERGE:
                i = ranks.index(best)
                parts[i] += parts.pop(i + 1)
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((parts[i - 1], parts[i]), NO_MERGE)
                if i < len(ranks):
                    ranks[i] = rank.get((parts[i], parts[i + 1]), NO_MERGE)
        else:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
            heapq.heapify(heap)
            while heap:
                _, i, left, right = heapq.heappop(heap)
                j = after[i]
                if parts[i] != left or j >= n or parts[j] != right:
                    continue
                parts[i], parts[j] = left + right, ""
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := rank.get((parts[i], parts[k]))) is not None:
                        heapq.heappush(heap, (r, i, parts[i], parts[k]))
                if (h := before[i]) >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                    heapq.heappush(heap, (r, h, parts[h], parts[i]))
            parts = [p for p in parts if p]
        return array("I", [self.vocab[p] for p in parts]).tobytes()

    def _word(self, word: str) -> bytes:
        """``word`` in byte letters."""
        symbols = list(word)
        symbols[-1] += END
        inner = self.inner
        ranks = [inner.get(pair, FORCED) for pair in zip(symbols, symbols[1:])]
        if FORCED not in ranks:  # one fragment, remembered as the word
            return self._merge(symbols, ranks)
        return b"".join(map(self.fragments.__getitem__, self.split(symbols)))

    def _plain(self, text: str) -> bytes:
        """A text without special tokens and ASCII white space."""
        if not text:
            return b""
        if text.isascii() and text.isprintable():
            low = text.lower()
            return self.words[low] if low.isalpha() else b"".join(map(self.words.__getitem__, _ASCII_WORDS.findall(low)))
        if max(text) < _FIRST_MARK:
            low = text.lower()
            words = [low] if low.isalpha() else _WORDS.findall(low)
            return b"".join([self.words[w.encode().decode("latin-1").translate(self.letters)] for w in words])
        return b"".join([self.words[w] for w, _ in self.pre_tokenize(self.normalize(text))])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if b"<|" in chunk and self.specials.search(text):
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def encode(self, text: bytes) -> bytes:
        """Ids as packed little-endian unsigned 32-bit numbers. Words never span white space."""
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """``encode`` of each text in turn. What is new in some texts is encoded together, and their ids are joined in arrays."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= AT_ONCE):
                size += len(texts[hi])
                hi += 1
            split = pc.ascii_split_whitespace(pa.array(texts[lo:hi], pa.large_binary()).view(pa.large_string()))
            coded = split.flatten().view(pa.large_binary()).dictionary_encode()
            found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            self._learn(found)
            packed = list(map(self.chunks.__getitem__, found))
            ids = np.frombuffer(b"".join(packed), "<u4")
            count = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            begin = np.cumsum(count) - count
            offsets, indices = split.offsets.to_numpy() - split.offsets[0].as_py(), coded.indices.to_numpy()
            del split, coded, packed, found
            for first in range(0, hi - lo, SOME_TEXTS):
                of = offsets[first : first + SOME_TEXTS + 1]
                chunk = indices[of[0] : of[-1]]
                n = count[chunk]
                ends = np.concatenate([[0], np.cumsum(n)])
                # Where the ids of each chunk begin, less the ids before it: a running number added to it walks through them.
                joined = ids[np.repeat(begin[chunk] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
                to = (ends[of - of[0]] * 4).tolist()
                for i, j in zip(to, to[1:]):
                    yield joined[i:j]
            lo = hi

    def _learn(self, found: list[bytes]) -> None:
        """Remember the ids of the plain ones of these different chunks; the others are left to be made when they are asked for."""
        chunks, words = self.chunks, self.plain
        new = [c for c in found if c not in chunks]
        if len(chunks) + len(new) > chunks.size:
            _keep(chunks, found)
        if len(new) < FEW_WORDS:
            return
        joined = b" ".join(new)
        if _NOT_PLAIN.search(joined):
            new = [c for c in new if not _NOT_PLAIN.search(c)]
            joined = b" ".join(new)
        low = joined.decode("utf-8", "replace").lower().split(" ")
        find = _plain_words()

        def parts() -> set[str]:
            return set(filter(str.isalpha, low)).union(chain.from_iterable(map(find, filterfalse(str.isalpha, low))))

        unknown = [w for w in parts() if w not in words]
        if len(words) + len(unknown) > self.remembered:
            _keep(words, parts())
        raw = list(map(str.encode, unknown))
        short = [n for n, w in enumerate(raw) if len(w) <= LONG_WORD]
        for i in range(0, len(short), WORDS_AT_ONCE):
            some = short[i : i + WORDS_AT_ONCE]
            words.update(zip([unknown[n] for n in some], self.merges.merge([raw[n] for n in some])))
        if len(short) < len(raw):
            words.update((w, self.words[b.decode("latin-1").translate(self.letters)]) for w, b in zip(unknown, raw) if len(b) > LONG_WORD)
        # A word is found as itself, so a chunk that is a word needs no search.
        chunks.update(zip(new, [words.get(w) or b"".join(map(words.__getitem__, find(w))) for w in low]))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space: this tokenizer has no decoder that would join them otherwise."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def encoder(path: str, remembered: int | None = None) -> ForcedBoundaryBpe:
    """One encoder per worker process. ``remembered``: entries of each of its memories at most, instead of ``CACHE_SIZE``."""
    forget(but=encoder.cache_clear)
    return ForcedBoundaryBpe(path, remembered)


MEMORIES.append(encoder.cache_clear)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids (array of int) of every whole text.

    Null and empty texts have no ids. Rows, repeated ones too, stay as they are; an input column
    named ``out`` is replaced; an empty table gives an empty table. Texts of any length are taken
    whole; a worker holds one batch of them. ``path`` must be readable on every machine.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = encoder(path)
        packed = list(bpe.encode_all(texts_of(batch, text)))
        offsets = [0]
        for p in packed:
            offsets.append(offsets[-1] + len(p) // 4)
        values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]

    return add_columns(df, f"`{out}` array<int>", make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of ``ids``; null and empty ids give the empty text, an unknown id is an error."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = encoder(path)
        column = batch.column(batch.schema.get_field_index(ids))
        return [pa.array([bpe.decode(x or ()) for x in column.to_pylist()], pa.string())]

    return add_columns(df, f"`{out}` string", make)


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every whole text (null: empty).

    Encoding and decoding in one pass, for checks of a round trip over a whole table: ids and
    decoded texts, several times the size of the texts, never leave the task.
    """

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = encoder(path)
        number = _numbers(path)
        counts, first, second = [], [], []
        for packed in bpe.encode_all(texts_of(batch, text)):
            ids = memoryview(packed).cast("I").tolist()
            counts.append(len(ids))
            first.append(hashlib.sha256(b" ".join(map(number.__getitem__, ids))).hexdigest())
            second.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]

    return add_columns(df, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


@functools.lru_cache(maxsize=2)
def _numbers(path: str) -> list[bytes]:
    return [str(i).encode() for i in range(max(encoder(path).tokens) + 1)]
