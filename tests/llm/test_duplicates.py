"""SimHash and product quantisation against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweft.llm import pq, simhash
from logweft.llm.common import components
from logweft.llm.queries import QUERIES
from logweft.session import materialize

from .conftest import ODD_ROWS


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(llm):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    want = _components(range(500), edges)
    got = dict(components(llm.createDataFrame(edges, "a long, b long")).collect())
    touched = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: want[n] for n in touched}
    assert components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_and_links(llm):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for v in base[:12]:
        for _ in range(12):
            x = v
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
            values.add(x)
    values |= {0, (1 << 64) - 1, 1, 1 << 63, 3 << 31}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = sorted((r.a, r.b) for r in simhash.links(llm.createDataFrame([(v,) for v in signed], "fp long")).collect())
    assert got == want  # each once
    for text in ["", "a", "A b", "a B c", "one two three four " * 300, *[r[1] or "" for r in ODD_ROWS]]:
        assert simhash.fingerprint(text.encode()) == _fingerprint(text)


def test_no_index_is_sent_to_the_driver(llm):
    """64 rows are made of each fingerprint of a small file, and groups grow with the documents: all are joined by shuffle."""
    docs = llm.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id") % 90, F.lit("b c"), F.col("id") % 7).alias("text"))
    fps = materialize(docs.select(F.xxhash64("doc_id").alias("fp")))
    for df, joins in ((simhash.links(fps), 1), (simhash.near_duplicates(docs), 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= joins, plan


def test_near_duplicates_on_odd_rows(llm, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD_ROWS)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id in (2, 3, 4)} == {(i, "0" * 16, 2) for i in (2, 3, 4)}
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    clash = odd.withColumnRenamed("lang", "fp").withColumnRenamed("source", "row")
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 7]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_query_near_duplicates(llm, sf_small):
    docs = llm.read.parquet(f"{sf_small}/documents.parquet").collect()
    fps = {r.doc_id: _fingerprint(r.text) for r in docs}
    ids = list(fps)
    root = _components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_deletion_variant_simhash"](llm, sf_small).collect()}
    assert got == {i: (f"{fps[i]:016x}", root[i]) for i in ids}


def test_keep_one_by_shingles(llm):
    """Texts of a five-word Jaccard similarity of 0.8 or more are one, whatever their fingerprints."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([30, 80, 400]))]
        texts.append(base)
        for _ in range(5):
            other = list(rng.choice(texts[-3:]))
            for _ in range(max(1, round(len(other) * rng.choice([0.005, 0.015, 0.02, 0.04])))):
                other[rng.randrange(len(other))] = word()
            texts.append(other)
    hub = [word() for _ in range(300)]
    texts += [hub, *[[*hub[:150], word(), *hub[151:]] for _ in range(60)], ["a"], ["b"], ["a", "b"], ["B"], []]
    rng.shuffle(texts)
    rows = list(enumerate(map(" ".join, texts)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for _, t in rows)]
    close = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    wide = [(a, b) for a, b in close if (_fingerprint(rows[a][1]) ^ _fingerprint(rows[b][1])).bit_count() > 2]
    assert len(wide) > 100
    root = _components(range(len(rows)), close)
    kept = simhash.keep_one(llm.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def _brute_vectors(rows, threshold=0.98):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    links, pairs = {}, []
    for r in good:
        n = 0
        for s in good:
            if s is not r and s[2] == r[2] and len(s[1]) == len(r[1]):
                x, y = np.array(r[1]), np.array(s[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold - 1e-12:
                    n += 1
                    pairs.append((r[0], s[0]))
        links.setdefault(r[0], []).append(n)
    root = _components({r[0] for r in rows if r[0] is not None}, pairs)
    out = []
    for r in rows:
        out.append((r[0], links[r[0]].pop(0) if r in good else 0, root.get(r[0])))
    return out


@pytest.mark.parametrize("block", [4096, 5])
def test_vectors(llm, monkeypatch, block):
    monkeypatch.setattr(pq, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for c in range(12):
        centre = rng.normal(size=8)
        for k in range(rng.integers(1, 9)):
            v = centre + rng.normal(size=8) * rng.choice([0, 0.02, 0.12, 0.3])
            rows.append((n, (v * rng.choice([1, 7.5])).tolist(), int(c % 3)))
            n += 1
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 8, 1), (n + 3, [1.0, None] + [0.0] * 6, 1), (n + 4, [float("nan")] * 8, 1),
             (n + 5, [float("inf")] + [1.0] * 7, 1), (n + 6, rows[0][1], None), (None, rows[0][1], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0)]
    rows += [(n + 9 + i, rows[0][1], rows[0][2]) for i in range(6)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    got = pq.link_vectors(df).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(_brute_vectors(rows), key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_an_empty_table(llm):
    assert pq.link_vectors(llm.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_asymmetric_distances_bound_the_true_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = pq.Codebook(x[:300], 6, 4, 16)
    lists, codes, error = book.encode(x)
    for c in range(len(book.centres)):
        at = np.flatnonzero(lists == c)
        d = np.sqrt(np.maximum(book.distances(x, c, codes[at]), 0))
        true = np.linalg.norm(x[:, None] - x[at][None], axis=2)
        assert (d <= true + error[at][None] + 1e-4).all()
    row, probe = book.probes(x, lists, 0.5)
    probed = set(zip(row.tolist(), probe.tolist()))
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.5
    assert all((i, lists[j]) in probed for i, j in zip(*np.nonzero(near)))


def test_query_vectors(llm, sf_small):
    rows = [tuple(r) for r in llm.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(close, False)
    ids = [r[0] for r in rows]
    root = _components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(close))])
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op1_pq_near_duplicates"](llm, sf_small).collect()}
    assert got == {v: (int(close[i].sum()), root[v]) for i, v in enumerate(ids)}


def test_texts_are_not_shuffled(llm, monkeypatch):
    """Rows are told by filters where they lie; only those that both filters let pass are joined."""
    from logweft.llm import common

    rows = materialize(llm.range(0, 3000, 1, 3).select(F.col("id").alias("row"), F.concat(F.lit("a b c d e f "), "id").alias("text")))
    wanted = materialize(rows.filter("row % 7 < 3").select("row"))
    others = materialize(rows.filter("row % 7 >= 3").select(F.col("row").alias("node")))
    broadcast = llm.conf.get("spark.sql.autoBroadcastJoinThreshold")
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for bits in (common.FILTER_BITS, 1 << 10):  # a few rows pass both filters, and most
            monkeypatch.setattr(common, "FILTER_BITS", bits)
            found = common.rows_in(rows, "row", wanted, others).collect()
            assert sorted(r.row for r in found) == [i for i in range(3000) if i % 7 < 3]
            assert all(r.text == f"a b c d e f {r.row}" for r in found)
        texts = rows.withColumnRenamed("row", "node")
        named = wanted.select(F.array("row").alias("nodes"))
        sets = simhash._sets(texts, named, simhash.JACCARD_SHINGLE)
        assert "SortMergeJoin" not in sets._jdf.queryExecution().executedPlan().toString()
        assert {r.row for r in wanted.collect()} <= {r.node for r in sets.collect()}
    finally:
        llm.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert common.rows_in(rows, "row", wanted.limit(0), rows.select("row")).count() == 0
