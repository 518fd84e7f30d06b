"""Encoding, decoding and packing against the tokenizers library."""

import functools
import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logweft.llm import bpe, common, packing, toxicity
from logweft.llm.queries import QUERIES

from .conftest import ODD_ROWS


@functools.lru_cache
def _tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _library(path, texts):
    t = _tokenizer(path)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)], t


def test_encoder_equals_library(path):
    pieces = st.sampled_from(
        ["a", "th", "ing", "'", "s", "'re", "S", "!", "...", " ", "\n", " ", "\x1c", "\x85", "é", "É", "é", "Ω", "ς", "Σ", "İ", "1", "½", "中",
         "<|endoftext|>", "<|", "ﬃ", "🎉", "ͅ", "​", "\x00", "</w>", "aaaa"]
    )
    mine = bpe.encoder(path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(pieces | st.text(max_size=3), max_size=14).map("".join))
    def check(text):
        text = text.encode("utf-8", "ignore").decode()
        (ids,), t = _library(path, [text])
        got = array("I", mine.encode(text.encode())).tolist()
        assert got == ids
        assert mine.decode(got) == t.decode(ids, skip_special_tokens=False)

    check()


def test_new_words_are_merged_together(path, monkeypatch):
    """Texts of new plain words need no merging word by word, and have the library's ids."""
    rng = np.random.default_rng(4)
    parts = np.array(["th", "ing", "on", "é", "Ö", "ß", "queen", "x", "zq", "'s", "1", "###", ".", "²", "ª", "Ⱥ", "İ"])
    texts = ["  ".join("".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(400)) for _ in range(6)]
    want, _ = _library(path, texts)
    mine = bpe.ForcedBoundaryBpe(path)
    monkeypatch.setattr(mine, "_merge", lambda *_: 1 / 0)
    got = [array("I", x).tolist() for x in mine.encode_all([t.encode() for t in texts])]
    assert got == want


def test_encode_all_equals_encode(path, monkeypatch):
    """Whatever the texts are, and however little a worker may remember or take together."""
    texts = [r[1] or "" for r in ODD_ROWS] + ["", " ", "a<|endoftext|>b <|", "中文 Ω ͅ", "w" * 61 + " " + "é" * 31, "\x00 \x1c\x85\xa0", "'s's 's"]
    raw = [t.encode() for t in texts] + [b"\xc3 \x80 a\xe2b", b" \x80"]
    one = bpe.ForcedBoundaryBpe(path)
    want = [one.encode(t) for t in raw]
    monkeypatch.setattr(bpe, "FEW_WORDS", 0)
    assert list(bpe.ForcedBoundaryBpe(path).encode_all(raw)) == want
    assert list(bpe.ForcedBoundaryBpe(path).encode_all([b"", b""])) == [b"", b""]
    assert list(one.encode_all([])) == []
    for name, value in (("AT_ONCE", 30), ("WORDS_AT_ONCE", 2), ("SOME_TEXTS", 2), ("CACHE_SIZE", 3)):
        monkeypatch.setattr(bpe, name, value)
    small = bpe.ForcedBoundaryBpe(path)
    small.chunks.size = 3
    assert list(small.encode_all(raw + raw)) == want + want
    pieces = st.sampled_from(["th", "ing", "'", "s", "'re", "S", "!", "...", " ", "\n", "\x1c", "\x85", "é", "Σ", "İ", "Ⱥ", "ɏ", "1", "½", "ª", "中", "ͅ", "</w>", "aaaa"])

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(pieces | st.text(max_size=3), max_size=14).map("".join), max_size=4))
    def check(found):
        found = [t.encode("utf-8", "ignore").decode() for t in found]
        assert [array("I", x).tolist() for x in small.encode_all([t.encode() for t in found])] == _library(path, found)[0]

    check()


def test_boundaries_are_certain(path):
    """Fragments on both sides of a forced boundary join to the ids of the whole; most long words have one."""
    mine = bpe.encoder(path)
    cut = 0
    for word in ("lowercasezqxjkunion", "qzqz", "abcdefghijklmnopqrstuvwxyz", "a" * 500, "thndqxing"):
        symbols = list(word)
        symbols[-1] += bpe.END
        parts = mine.split(symbols)
        cut += len(parts) > 1
        assert b"".join(mine._merge(list(p)) for p in parts) == mine._merge(list(symbols))
        assert [s for p in parts for s in p] == symbols
    assert cut >= 2


def test_round_trip_on_odd_rows(llm, odd, path):
    want, t = _library(path, [r[1] or "" for r in ODD_ROWS])
    got = bpe.digests(odd, path).collect()
    key = lambda text, ids: (text, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert sorted((r.text or "", r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(key(r[1] or "", i) for r, i in zip(ODD_ROWS, want))
    assert bpe.digests(odd.limit(0), path).count() == 0
    both = bpe.decode(bpe.encode(odd.withColumnRenamed("n_chars", "ids"), path), path).select("text", "ids", "decoded").collect()
    assert all(r.decoded == t.decode(list(r.ids), skip_special_tokens=False) for r in both) and len(both) == len(odd.collect())


def test_best_two_fit_places_all():
    rng = np.random.default_rng(7)
    for capacity, high, n in ((10, 10, 200), (64, 20, 500), (4096, 4096, 300), (5, 5, 1), (7, 7, 0)):
        lengths = rng.integers(1, high + 1, n)
        bins, offsets = packing.best_two_fit(lengths, capacity)
        for b in set(bins.tolist()):
            at = np.flatnonzero(bins == b)
            at = at[np.argsort(offsets[at])]
            assert offsets[at].tolist() == [0, *np.cumsum(lengths[at])[:-1].tolist()] and lengths[at].sum() <= capacity
        used = len(set(bins.tolist()))
        assert used >= -(-int(lengths.sum()) // capacity)
        if high < capacity:
            assert used <= 1.05 * lengths.sum() / capacity + 1


def test_two_fit_replaces_the_smallest():
    # Greedy 6 + 3 leaves 1; taking the 3 out, 2 + 2 fills the bin.
    bins, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]


def test_packed_pieces(llm, odd, path):
    want = {}
    ids, _ = _library(path, [r[1] or "" for r in ODD_ROWS])
    for r, i in zip(ODD_ROWS, ids):
        full = [*i, 1]
        for n, lo in enumerate(range(0, len(full), 64)):
            key = (r[0], n, lo, len(full[lo : lo + 64]), zlib.crc32(np.array(full[lo : lo + 64], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    clash = odd.withColumnRenamed("source", "offset").withColumnRenamed("lang", "piece")
    got = packing.pack_documents(clash, path, 64).collect()
    have, places = {}, {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        have[key] = have.get(key, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert have == want
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_queries(llm, sf_small, path):
    docs = llm.read.parquet(f"{sf_small}/documents.parquet").collect()
    want, _ = _library(path, [r.text or "" for r in docs])
    total = sum(len(i) + 1 for i in want)
    got = QUERIES["op4_best_two_fit"](llm, sf_small).collect()
    assert sum(r.length for r in got) == total
    assert len({r.sequence_id for r in got}) <= 1.02 * total / 4096 + 1
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op3_bpe_round_trip"](llm, sf_small).collect()}
    assert counts == {r.doc_id: len(i) for r, i in zip(docs, want)}


def test_stages_leave_each_other_room(llm, path):
    """An encoder and a restorer are not remembered side by side, and whole texts come in batches of some MB."""
    bpe.encoder(path)
    toxicity._scorer((-1.0,) * toxicity.LETTERS**3, 0.1, ())
    assert bpe.encoder.cache_info().currsize == 0
    bpe.encoder(path)
    assert toxicity._scorer.cache_info().currsize == 0

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = llm.conf.get(key)
    try:
        docs = llm.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 4000).alias("text"))  # 40 MB in one task
        corpus_pipeline.packed(llm, docs.select(F.lit(1).alias("doc_id"), "text").limit(0), "")
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
    finally:
        llm.conf.set(key, before)
    assert sum(r.n for r in got) == 2000
    assert max(r.bytes for r in got) <= 2 * common.BATCH_BYTES


def test_stages_bound_what_workers_hold(llm, path, monkeypatch):
    """Batches of a megabyte, few rows read at once and small memories in all stages; ids do not depend on what is remembered."""
    raw = [" ".join(f"{a}{b}x{i}" for a in "abcdef" for b in "ghijkl").encode() for i in range(60)]
    small = bpe.ForcedBoundaryBpe(path, 50)
    want = list(bpe.ForcedBoundaryBpe(path).encode_all(raw))
    got = [ids for t in raw for ids in small.encode_all([t])]
    assert got == want
    assert max(map(len, (small.chunks, small.plain, small.words, small.fragments))) <= 50

    words = [w for w in b"sh1t s-h-i-t h e l l o he llo go0d wo rd".split()] * 3
    model = [-1.0] * toxicity.LETTERS**3
    few, many = toxicity.Restorer(model, 4), toxicity.Restorer(model)
    assert [few.of(b" ".join(words[i:])) for i in range(9)] == [many.of(b" ".join(words[i:])) for i in range(9)]
    assert max(map(len, (few.words, few.runs, few.pieces))) <= 4

    asked = {}
    scores = toxicity.score
    monkeypatch.setattr(toxicity, "fit", lambda *_, remembered, **__: asked.update(fit=remembered) or toxicity.ToxicityModel(tuple(model), {}, 0.1))
    monkeypatch.setattr(toxicity, "score", lambda *a, remembered, **b: asked.update(score=remembered) or scores(*a, **b, remembered=remembered))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: llm.createDataFrame([], "doc_id long, toxic int"))
    pack = corpus_pipeline.packing.pack_documents
    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", lambda *a, remembered, **b: asked.update(pack=remembered) or pack(*a, **b, remembered=remembered))
    keys = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = [llm.conf.get(k) for k in keys]
    try:
        docs = llm.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
        assert corpus_pipeline.without_toxic(llm, docs, "").count() == 2
        assert corpus_pipeline.packed(llm, docs, "").count() == 2
        held = [int(llm.conf.get(k)) for k in keys]
    finally:
        for k, v in zip(keys, before):
            llm.conf.set(k, v)
    assert asked == dict.fromkeys(["fit", "score", "pack"], corpus_pipeline.REMEMBERED)
    assert corpus_pipeline.REMEMBERED <= 100_000 and held[0] <= 1 << 20 and held[1] <= 512
