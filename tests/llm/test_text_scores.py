"""Toxicity, line quality, repetition and language-model scores."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweft.llm import linecrf, lm, suffixes, toxicity
from logweft.llm.queries import QUERIES

from .conftest import DOC_SCHEMA, ODD_ROWS

WORDS = "the river flows past green hills while people walk along quiet paths and talk about simple things they saw today".split()


def _sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# ------------------------------------------------------------------ toxicity


@pytest.fixture(scope="module")
def insults(llm):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        text = _sentence(rng, 30) + " you "  # said to all, so that only the insult tells
        if toxic:
            text += rng.choice(["idiot", "moron", "idiots"]) + " " + _sentence(rng, 8)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (500, 1, 1)]
    return llm.createDataFrame(docs, DOC_SCHEMA), llm.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_disguised_insults(llm, insults):
    docs, labels = insults
    model = toxicity.fit(docs, labels)
    tests = {
        "what an 1d10t he is": True, "you IDIOT!!": True, "such an iiidiooot": True, "i d i o t go home": True, "an i.d.i.o.t again": True,
        "m0r0n": True, "!d!ot": True, "you are a i d i o t": True, "i  d  i  o  t": True, "i\td\ti\to\tt": True, "i\nd\ni\no\nt": True,
        "you id iot": True, "idioot": True, "iidiot": True, "i * d * 1 * 0 * t": True, "i. d. i. o. t.": True, "a way to go in it is as we do": False,
        "the river flows past 12 green hills": False, "": False, "in 2024 people saw 3 hills!!!": False,
    }
    got = toxicity.score(llm.createDataFrame(list(enumerate(tests)), "n int, text string"), model).collect()
    assert {r.text: r.score >= 0.7 for r in got} == tests


def test_viterbi_is_the_best_reading():
    rng = random.Random(0)
    counts = np.array([rng.randrange(1, 50) for _ in range(toxicity.LETTERS**3)])
    model = toxicity.character_model(counts)

    def readings(word, last=""):
        if not word:
            yield "", 0.0
            return
        c = word[0]
        if c in toxicity.LEET:
            letters = toxicity.LEET[c]
            dropped = toxicity.DIGIT_DROPPED if c.isdigit() else toxicity.SIGN_DROPPED
            own = [(x, toxicity.READ_AS - math.log(len(letters))) for x in letters] + [("", dropped)]
        elif not c.isalpha():
            dropped, kept = toxicity.GAPS.get(c, toxicity.MARK)
            own = [("", dropped), (" ", kept)]
        else:
            own = [(c, toxicity.AS_IT_IS)] + ([("", toxicity.UNDOUBLED)] if c == last else [])
        for tail, cost in readings(word[1:], c):
            for letter, more in own:
                yield letter + tail, cost + more

    def value(text, cost):
        a = b = toxicity.SPACE
        for k in [*[toxicity.SPACE if c == " " else ord(c) - 97 for c in text], toxicity.SPACE]:
            cost += model[(a * toxicity.LETTERS + b) * toxicity.LETTERS + k]
            a, b = b, k
        return cost

    for word in ("a1b", "h3ll0", "aa1ii", "$t*p", "ooo0", "a b1 c", "to\nbe.1"):
        best = max(value(t, c) for t, c in readings(word))
        found = toxicity.viterbi(word, model)
        assert max(value(t, c) for t, c in readings(word) if t == found) == pytest.approx(best)


def test_neighbours_are_told_without_decoding(monkeypatch):
    """Two plain pieces are read as decoding them reads them, by the letters at the gap alone."""
    rng = random.Random(4)
    model = toxicity.character_model(np.array([rng.randrange(1, 50) ** 2 for _ in range(toxicity.LETTERS**3)]))
    restorer, calls, decode = toxicity.Restorer(model), [], toxicity.viterbi
    monkeypatch.setattr(toxicity, "viterbi", lambda word, model: calls.append(word) or decode(word, model))
    told = Counter()
    for _ in range(3000):
        first, second = ("".join(rng.choices("abcdeilnorst", k=rng.randrange(2, 5))) for _ in "ab")
        doubled = any(a == b for w in (first, second) for a, b in zip(w, w[1:]))
        calls.clear()
        found = restorer.spaced(f"{first} {second}.".encode())
        assert doubled or not calls
        assert found == set(decode(f"{first}\n{second}", model).split(" ")) - {first, second, ""}
        told[bool(found)] += not doubled
    assert min(told.values()) > 100


def test_toxicity_of_odd_rows(llm, odd, insults):
    model = toxicity.fit(odd, insults[1].limit(0))
    got = toxicity.score(odd.withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == len(ODD_ROWS) and {r.score for r in got} == {model.base}
    empty = toxicity.fit(odd.limit(0), insults[1])
    assert toxicity.score(odd.limit(0), empty).count() == 0


def _held_out(llm, sf, name, column):
    labels = {r.doc_id: r[column] for r in llm.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](llm, sf).collect()
    assert len(rows) == llm.read.parquet(f"{sf}/documents.parquet").count() and all(0 <= r.score <= 1 for r in rows)
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_query_toxicity_held_out(llm):
    got = _held_out(llm, "/root/testdata/sf0.01", "op6_noisy_channel_toxicity", "toxic")
    assert sum(r.predicted == y for r, y in got) >= 0.93 * len(got)
    assert sum(r.predicted for r, y in got if y) >= 0.7 * sum(y for _, y in got)


# ------------------------------------------------------------------ quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4, 0, 2])
    starts = np.cumsum(counts) - counts
    emission, pair = rng.normal(size=counts.sum()), np.exp(rng.normal(size=(2, 2)))
    good, expected = linecrf._marginals(emission, starts, counts, pair, pairs=True)
    want, moves = np.zeros(counts.sum()), np.zeros((2, 2))
    for s, n in zip(starts, counts):
        total, line, move = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            y = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(emission[s + i] for i in range(n) if y[i]))
            for a, b in zip(y, y[1:]):
                w *= pair[a, b]
            total += w
            line += w * np.array(y)
            for a, b in zip(y, y[1:]):
                move[a, b] += w
        if n:
            want[s : s + n] = line / total
            moves += move / total
    assert np.allclose(good, want) and np.allclose(expected, moves)


def test_likelihood_of_labels_sums_over_line_labels():
    """A good label is all lines good, a bad one anything else; by enumeration, the slope by differences."""
    rng = np.random.default_rng(1)
    counts, quality = np.array([3, 1, 0, 4, 2]), np.array([0, 1, 1, 0, 1])
    x = rng.normal(size=(counts.sum(), linecrf.FEATURES))
    theta = rng.normal(size=linecrf.FEATURES + 4) * 0.3
    emission, pair = x @ theta[:-4], theta[-4:].reshape(2, 2)
    want = 0.0
    for s, n, q in zip(np.cumsum(counts) - counts, counts, quality):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = math.exp(sum(emission[s + i] for i in range(n) if y[i]) + sum(pair[a, b] for a, b in zip(y, y[1:])))
        if n:
            good = weights[(1,) * int(n)] / sum(weights.values())
            want += math.log(good if q else 1 - good)
    value, slope = linecrf._log_likelihood(theta, x, counts, quality)
    assert abs(value - want) < 1e-9
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-5
        up, down = (linecrf._log_likelihood(theta + d, x, counts, quality)[0] for d in (step, -step))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-5


def test_bad_block_in_a_good_page():
    """Taught by whole documents only, the model tells the bad lines of a page from its good ones.

    Lines beside the block may go either way: no label of a document says where a block ends.
    """
    rng = random.Random(4)
    words = "the river runs past old mills where people once made paper and cloth for towns nearby".split()
    good_line = lambda: (" ".join(rng.choices(words, k=rng.randint(8, 16))).capitalize() + ".").encode()
    bad_line = lambda: " ".join(rng.choices(["#$%", "||", "BUY", "99", "$$$", "<<>>"], k=10)).encode()

    def page(k):
        if k % 3:
            return [good_line() for _ in range(rng.randint(1, 8))], 1
        lines = [good_line() for _ in range(rng.randint(0, 5))] + [bad_line() for _ in range(rng.randint(1, 4))]
        return lines[k % 2 :] if len(lines) > 1 else lines, 0

    pages = [page(k) for k in range(300)]
    rows, lengths, counts = [], [], []
    for lines, _ in pages:
        r, n = linecrf.line_features(b"\n".join(lines))
        rows += r
        lengths += n
        counts.append(len(r))
    model = linecrf._train(np.array(rows), np.array(lengths, float), np.array(counts), np.array([q for _, q in pages]))
    mixed = [good_line() for _ in range(4)] + [bad_line() for _ in range(3)] + [good_line() for _ in range(4)]
    states = (linecrf.line_chances(b"\n".join(mixed), model) > 0.5).tolist()
    assert len(states) == 11 and all(states[:3]) and not any(states[4:7]) and all(states[8:])
    assert linecrf.line_chances(b" \n", model).tolist() == []


def test_quality_of_odd_rows(llm, odd):
    labels = llm.createDataFrame([(1, 1), (7, 0), (7, 1), (None, 1), (6, 0)], "doc_id long, quality int")
    model = linecrf.fit(odd, labels)
    got = linecrf.score(odd.withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not (r.text or "").strip()} == {model.base}
    nothing = linecrf.fit(odd, labels.limit(0))
    assert len({r.score for r in linecrf.score(odd, nothing).collect()}) <= 2
    assert linecrf.score(odd.limit(0), nothing).count() == 0


def test_query_quality_held_out(llm):
    got = _held_out(llm, "/root/testdata/sf0.01", "op9_line_crf_quality", "quality")
    assert sum(r.predicted == y for r, y in got) >= 0.97 * len(got)


# ------------------------------------------------------------------ repetition


def _brute_repeats(words, lengths, window):
    n = len(words)
    longest, covered, windowed = 0, [set() for _ in lengths], set()
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        longest = max(longest, best)
        for least, places in zip(lengths, covered):
            places |= set(range(i, i + best)) if best >= least else set()
        windowed |= set(range(i, i + window)) if best >= window else set()
    return n, tuple(map(len, covered)), longest, len(windowed)


def test_repeats_equal_brute_force():
    rng = random.Random(3)
    for _ in range(80):
        texts = [[b"w%d" % rng.randrange(rng.choice([1, 2, 3, 10, 40])) for _ in range(rng.choice([0, 1, 2, 7, 30, 80]))] for _ in range(rng.randrange(1, 6))]
        lengths = (5, 6, 9)
        assert suffixes._repetition(texts, lengths, 5) == [_brute_repeats(w, lengths, 5) for w in texts]


def test_rates_of_odd_rows(llm, odd):
    got = suffixes.rate(odd.withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD_ROWS)
    for i in (2, 3, 4):
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, 0, 0, True, False)
    assert by[6].longest_repeat == 8999 and by[6].n_repeat_words == 9000 and not by[6].kept
    assert suffixes.rate(odd.limit(0)).count() == 0


def test_repetition_verdict(llm):
    rng = random.Random(8)
    clean = "\n".join(f"{_sentence(rng, 9)} {i} {rng.random()}" for i in range(40))
    passage = " ".join(f"u{i}" for i in range(60))
    filler = " ".join(f"v{i}" for i in range(2000))
    # 12 of 210 words stand twice, 11.4 %: more than repeats of 9 words may cover, less than those of 8.
    between = " ".join(f"x{i}" for i in range(186))
    long_part = " ".join(f"y{i}" for i in range(12))
    short_parts = " ".join(f"z{i}" for i in range(5))
    texts = {
        "clean": clean, "twice": f"{passage} {filler} {passage}", "signs": " ".join(f"w{i}***" for i in range(80)),
        "ten": f"{long_part} {between} {long_part}", "five": f"{short_parts} a {between} b {short_parts}",
        "base": " ".join(["one two three four five six"] * 5), "short": "too few words",
    }
    got = {r.k: (r.base_failed, r.failed_length, r.kept) for r in suffixes.rate(llm.createDataFrame(list(texts.items()), "k string, text string")).collect()}
    assert got == {
        "clean": (False, None, True), "twice": (False, None, False), "signs": (False, None, True), "ten": (False, 9, False),
        "five": (False, None, True), "base": (True, 5, False), "short": (True, None, False),
    }


def test_query_repetition(llm, sf_small):
    for r in QUERIES["op8_suffix_repetition"](llm, sf_small).join(llm.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        words, seen = r.text.split(), Counter()
        lines = [x for x in r.text.split("\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(r.text.count(c) for c in "#*$%&|<>")
        windows = list(zip(*[words[i:] for i in range(5)]))
        seen.update(windows)
        assert r.n_repeat_words == len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)})
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


# ------------------------------------------------------------------ language models


def _brute_losses(rows, path, weight=lm.WEIGHT):
    t = Tokenizer.from_file(path)
    size = t.get_vocab_size() + 1
    texts = [(t.encode(x or "", add_special_tokens=False).ids, m) for x, m in rows]
    big, one, context = ({True: Counter(), False: Counter()} for _ in range(3))
    for ids, m in texts:
        for a, b in zip([-1, *ids], ids):
            big[m][a, b] += 1
            one[m][b] += 1
            context[m][a] += 1
    total = {m: sum(one[m].values()) for m in one}

    def loss(ids, m):
        p = [(big[m][a, b] + weight * (one[m][b] + 1) / (total[m] + size)) / (context[m][a] + weight) for a, b in zip([-1, *ids], ids)]
        return -sum(map(math.log, p)) / len(ids) if ids else 0.0

    return [(len(ids), loss(ids, True), loss(ids, False)) for ids, m in texts if not m]


@pytest.mark.parametrize("block", [10**6, 40])
def test_losses_equal_brute_force(llm, path, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    rng = random.Random(6)
    rows = [(_sentence(rng, rng.randrange(1, 20)), i % 3 == 0) for i in range(40)] + [(None, False), ("", True), ("same text", False), ("same text", False)]
    df = llm.createDataFrame([(i, t, m or None) for i, (t, m) in enumerate(rows)], "score int, text string, mark boolean").repartition(3)
    got = sorted(tuple(r)[:3] for r in lm.cross_entropy_difference(df, path, "mark", ["score"]).select("n_tokens", "target_loss", "background_loss").collect())
    want = sorted(_brute_losses(rows, path))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose(np.array(got), np.array(want), rtol=1e-4)


def test_losses_of_an_empty_table(llm, path, odd):
    assert lm.cross_entropy_difference(odd.limit(0).withColumn("m", F.lit(True)), path, "m", ["doc_id"]).count() == 0
    assert lm.cross_entropy_difference(odd.withColumn("m", F.lit(False)), path, "m", ["doc_id", "lang"]).count() == len(ODD_ROWS)


def test_query_losses(llm, sf_small, path):
    docs = llm.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    turns = llm.read.parquet(f"{sf_small}/conversations.parquet").select("text").collect()
    want = dict(zip([r.doc_id for r in docs], _brute_losses([(r.text, False) for r in docs] + [(r.text, True) for r in turns], path)))
    got = QUERIES["op2_cross_entropy_difference"](llm, sf_small).collect()
    assert len(got) == len(docs)
    for r in got:
        n, t, b = want[r.doc_id]
        assert r.n_tokens == n and r.target_loss == pytest.approx(t, rel=1e-3) and r.background_loss == pytest.approx(b, rel=1e-3)
        assert r.score == pytest.approx(r.target_loss - r.background_loss)
