"""Runs, Merkle manifests and fingerprints against plain loops."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from logweft.llm import fingerprints, merkle, periods
from logweft.llm.queries import QUERIES, SQL

# ------------------------------------------------------------------ runs


def _brute_runs(words, least=12):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)  # periods come in ascending order
            i = j + 1
    return sorted((s, k, q) for (s, k), q in best.items())


def _repetitive(rnd):
    letters = rnd.choice([1, 2, 3, 5, 30])
    words = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randrange(60))]
    for _ in range(rnd.randrange(4)):
        block = [b"%d" % rnd.randrange(letters) for _ in range(rnd.randrange(1, 15))]
        words += (block * 20)[: rnd.randrange(1, 80)]
        if rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = b"x"
    return words * 2 if rnd.random() < 0.3 else words


def test_runs_equal_brute_force():
    rnd = random.Random(7)
    texts = [_repetitive(rnd) for _ in range(600)] + [[], [b"a"] * 3000, [b"a", b"b"] * 11 + [b"a"]]
    for words, (same, runs) in zip(texts, periods.runs_of(iter(texts))):
        assert words is same
        assert [tuple(r) for r in runs.tolist()] == _brute_runs(words) if len(words) < 500 else runs.tolist() == [[0, len(words), 1]]


def test_grammar_derives_the_text():
    """The places of a rule all hold the same words, and rules are binary."""
    words = np.array([0, 1, 2] * 20 + [3, 4] * 9 + [0, 1, 2, 3] * 5)
    rule, start, middle, end = periods.grammar(words, np.zeros(len(words), np.int64))
    held = {}
    for r, s, m, e in zip(rule.tolist(), start.tolist(), middle.tolist(), end.tolist()):
        assert s < m < e
        assert held.setdefault(r, (m - s, words[s:e].tolist())) == (m - s, words[s:e].tolist())
    assert len(held) < len(rule) and (end - start).max() == len(words)


def _runs_row(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _brute_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def _rows(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_run_rows(llm, odd):
    got = periods.detect(odd.withColumn("start", F.lit("clash")), planted="doc_id")
    small = [r for r in odd.collect() if len(r.text or "") < 40000]
    want = sorted(repr(_runs_row(r.doc_id, r.text)) for r in small)
    assert _rows(got.filter("doc_id <> 6 or doc_id is null"), *RUN_COLUMNS) == want
    long = got.filter("doc_id = 6").first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 9000, 1, 9_000_000)
    assert long.collapsed_sha256 == hashlib.sha256(b"word").hexdigest()
    assert periods.detect(odd.limit(0)).count() == 0


def test_query_runs(llm, sf_small):
    docs = llm.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    # The plain loop is quadratic: short texts are compared in full, long ones by the tests above.
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 12000}
    got = QUERIES["op11_grammar_runs"](llm, sf_small)
    assert got.count() == len(docs)
    want = sorted(repr(_runs_row(*x)) for x in short.items())
    assert _rows(got.filter(F.col("doc_id").isin(list(short))), *RUN_COLUMNS) == want


# ------------------------------------------------------------------ manifests


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_states_are_those_of_sha256():
    rnd = random.Random(3)
    digests = [_hash(str(rnd.random())) for _ in range(21)]
    level = merkle._blocks(np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64))
    upper, before = merkle.parents(level)
    assert [x.tobytes().decode() for x in merkle._text(upper)] == [_hash(*digests[i : i + 8]) for i in (0, 8, 16)]
    other = [_hash(x, "changed") for x in digests]
    own = merkle._blocks(np.frombuffer("".join(other).encode(), np.uint8).reshape(-1, 64))
    folded = merkle.fold(own, np.arange(21), level, before)
    for i, x in enumerate(merkle._text(folded)):
        first = i - i % 8
        assert x.tobytes().decode() == _hash(*[other[i] if j == i else digests[j] for j in range(first, min(first + 8, 21))])


def _brute_manifest(rows, tampered):
    """rows: (lang, doc_id, leaf, other leaf)."""

    def climb(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([_hash(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def fold(levels, i, own, siblings):
        for level in levels[:-1]:
            first = i - i % 8
            run = level[first : first + 8]
            siblings += [x for k, x in enumerate(run) if k != i - first]
            own = _hash(*[own if k == i - first else x for k, x in enumerate(run)])
            i //= 8
        return own

    langs = sorted({r[0] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    trees = [climb([r[2] for r in sorted((r for r in rows if r[0] == x), key=order)]) for x in langs]
    top = climb([t[-1][0] for t in trees])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(sorted((r for r in rows if r[0] == x), key=order)):
            siblings = []
            own = fold(top, k, fold(trees[k], i, r[3] if tampered(r[1]) else r[2], siblings), siblings)
            root = top[-1][0]
            out.append((r[1], r[2], trees[k][-1][0], root, _hash(*siblings), own, own == root))
    return sorted(map(repr, out))


MANIFEST_COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _manifest(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return merkle.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], {"text": lower}, crc % 3 == 0)


def _leaf(*values):
    return _hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _manifest_rows(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    values = lambda r, text: _leaf(r.doc_id, r.source, r.lang, r.n_chars, text)
    rows = [(r.lang, r.doc_id, values(r, r.text), values(r, r.text and r.text.translate(low))) for r in docs]
    return _brute_manifest(rows, lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0)


def test_manifest_of_odd_rows(llm, odd):
    docs = odd.withColumn("leaf", F.lit("clash")).withColumn("root", F.lit(1))
    assert _rows(_manifest(docs), *MANIFEST_COLUMNS) == _manifest_rows(odd.collect())
    assert _manifest(docs.limit(0)).count() == 0
    one = odd.filter("doc_id = 1")
    row = _manifest(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == _hash()


def test_manifest_over_several_tables(llm):
    """More leaves than one subtree holds, many keys, and a tree of exactly a power of eight."""
    parts = [("a", 5000), ("b", 4096), ("c", 513), *((f"k{i}", 1 + i % 3) for i in range(70))]
    rows = [(n * 10_000 + i, f"Text {i}", lang, "s", i) for n, (lang, many) in enumerate(parts) for i in range(many)]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert _rows(_manifest(df), *MANIFEST_COLUMNS) == _manifest_rows(df.collect())


def test_query_manifest(llm, sf_small):
    got = QUERIES["op12_merkle_manifest"](llm, sf_small)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_small}/documents.parquet'")
    want = con.execute(SQL["op12_merkle_manifest"]).fetchall()
    assert _rows(got, *MANIFEST_COLUMNS) == sorted(map(repr, want))


# ------------------------------------------------------------------ fingerprints


def _brute_fingerprint(text):
    words = [w for w in text.lower().encode().split()]
    votes, weight = [0] * 64, 0
    terms = [(xxhash.xxh64_intdigest(w, 42), len(w.decode())) for w in words]
    terms += [
        (xxhash.xxh64_intdigest(v, xxhash.xxh64_intdigest(w, 42)), len(w.decode()) + len(v.decode())) for w, v in zip(words, words[1:])
    ]
    for h, m in terms:
        weight += m
        for i in range(64):
            votes[i] += m * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > weight)


def _brute_edited(rows, radius=3):
    digest = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    fps = [_brute_fingerprint(t) for _, t in rows]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    lowest = {}
    for (i, _), f in zip(rows, fps):
        have = lowest.get(find(f))
        lowest[find(f)] = i if have is None else have if i is None else min(i, have)
    out = []
    for k, ((i, t), f) in enumerate(zip(rows, fps)):
        j = (k + 1) % len(rows)
        q = len(t) // 4
        edited = t[: len(t) - q] + rows[j][1][:q]
        e = _brute_fingerprint(edited)
        like = lambda x, y: 1 - (x ^ y).bit_count() / 64
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}", like(f, e), like(f, fps[j]), lowest[find(f)]))
    return sorted(map(repr, out))


PRINT_COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component_id")


def test_fingerprints_of_odd_rows(llm, odd):
    small = odd.filter("doc_id is null or doc_id not in (5, 6)").withColumn("near_next", F.lit("clash"))
    more = small.unionByName(small.filter("doc_id = 1")).unionByName(small.filter("doc_id = 1")).unionByName(
        llm.createDataFrame([(1, "Other text of one id", "en", "a", 3, "x"), (9, "ab", "en", "a", 2, "x")], small.schema)
    )
    got = fingerprints.compare_edited(more)
    assert _rows(got, *PRINT_COLUMNS) == _brute_edited([(r.doc_id, r.text) for r in more.collect()])
    assert fingerprints.compare_edited(more.limit(0)).count() == 0
    one = fingerprints.compare_edited(more.filter("doc_id = 9")).first()
    assert (one.near_edited, one.near_next, one.component_id) == (1.0, 1.0, 9)


def test_query_fingerprints(llm, sf_small):
    docs = llm.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_block_table_fingerprints"](llm, sf_small)
    assert _rows(got, *PRINT_COLUMNS) == _brute_edited([tuple(r) for r in docs])


def test_near_fingerprints_are_all_found(llm, monkeypatch):
    """Chains, dense balls and two balls under one key, with slices smaller than a key."""
    monkeypatch.setattr(fingerprints, "SLICE", 8)
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    values = set(seeds)
    for s in seeds[:4]:
        for _ in range(60):
            values.add(s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6))))
    for s in seeds[4:8]:  # a chain of steps of three bits
        for k in range(12):
            s ^= sum(1 << b for b in rnd.sample(range(64), 3))
            values.add(s)
    near = seeds[8] ^ sum(1 << b for b in (0, 1, 2, 3, 4))
    values |= {near} | {near ^ 1 << b for b in range(5, 11)} | {seeds[8] ^ 1 << b for b in range(11, 21)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = llm.createDataFrame([(v,) for v in signed], "fp long")
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {(r.fp, r.root) for r in fingerprints.groups(df).collect()} == {(v, find(v)) for v in signed}
