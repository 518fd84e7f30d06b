"""WARC archives, quotation linking and the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweft.llm import chat, warc
from logweft.llm.queries import QUERIES
from logweft.session import scratch_path

from .conftest import DOC_SCHEMA, ODD_ROWS

FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


def _expected(rows):
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h) if i is not None else None
        again = f is not None and f != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    return out


def _key(r):
    return tuple((v is None, v or 0) for v in r)


@pytest.mark.parametrize("split", ["128m", "2000"])
def test_archives(llm, split):
    rng = random.Random(5)
    kinds = ["", None, "é" * 120, FAKE, "a" + FAKE + FAKE + "WARC/1.1\n\nWARC/1.0\r\n", "same" * 50, "\nWARC/1.", "y" * 3000 + FAKE + "z" * 3000, "\r\n\r\n" * 30, FAKE.rstrip()]
    urls = ["http://a/WARC/1.1 b", "http://é.org/\nWARC/1.1\r\nX: y", None]
    rows = [(i, rng.choice(urls), rng.choice([*kinds, "x" * rng.randrange(300)])) for i in range(40)]
    rows += [(None, "u", "n" * 150), (None, "u", "n" * 150), (3, None, rows[3][2])]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).repartition(2)
    before = llm.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        llm.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.archive(llm, pages).collect()
    finally:
        llm.conf.set("spark.sql.files.maxPartitionBytes", before)
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in got]
    assert sorted(have, key=_key) == sorted(_expected(rows), key=_key)
    assert warc.archive(llm, pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", ["128m", "50000"])
def test_archives_with_long_urls(llm, split):
    """Headers of several 100 KB; the pages after them in the same file are read too."""
    long = "http://a/" + "p" * 400_000 + "/WARC/1.1"
    rows = [(i, long if i % 3 == 1 else "u", f"page {i} " * 20 + (FAKE if i % 4 == 1 else "")) for i in range(9)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    before = llm.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        llm.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = warc.archive(llm, pages).collect()
    finally:
        llm.conf.set("spark.sql.files.maxPartitionBytes", before)
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in got]
    assert sorted(have, key=_key) == sorted(_expected(rows), key=_key)


def test_archives_with_two_payloads_of_a_page(llm):
    """Of two rows of one page_id only the one whose payload a smaller page has is a revisit."""
    rows = [(1, "u", "a" * 150), (2, "u", "a" * 150), (2, "v", "b" * 150), (3, "u", "b" * 150), (3, "v", "a" * 150)]
    got = warc.archive(llm, llm.createDataFrame(rows, "page_id long, url string, html string")).collect()
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in got]
    assert sorted(have, key=_key) == sorted(_expected(rows), key=_key)


def test_broken_archives(llm, tmp_path):
    """A chain ends at a broken record; a file without a first record has none."""
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    (tmp_path / "a.txt").write_bytes((good % 1 + good % 2 + "WARC/1.1\r\nno length\r\n\r\n\r\n\r\n" + good % 3).encode())
    (tmp_path / "b.txt").write_bytes(("junk\r\n" + good % 4).encode())
    (tmp_path / "c.txt").write_bytes((good % 5 + (good % 6)[:-6]).encode())
    got = sorted((r.page_id, r.payload_digest is not None) for r in warc.read_warc(llm, str(tmp_path)).collect())
    assert got == [(1, True), (2, True), (5, True), (6, False)]


def test_query_archives(llm, sf_small):
    rows = [tuple(r) for r in llm.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in QUERIES["op5_warc_round_trip"](llm, sf_small).collect()]
    assert sorted(got, key=_key) == sorted(_expected(rows), key=_key)


# ------------------------------------------------------------------ quotes


def _brute_quotes(rows):
    """(conv, turn) -> (n_quotes, n_linked, reply_to, depth, position), by comparing every passage with all stretches of lines."""

    def blocks(text):
        """Lines as (depth, words), quotes parted by depth and blank lines, own text by quotes only."""
        out, last = [], None
        for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
            depth, rest = 0, line
            while rest.lstrip(" \t").startswith(">"):
                rest, depth = rest.lstrip(" \t")[1:], depth + 1
            words = tuple(rest.lower().split())
            if words and last == depth:
                out[-1][1].append(words)
            elif words:
                out.append((depth, [words]))
            if words or depth or last:  # a blank line does not part own text
                last = depth if words else None
        return out

    def holds(own, passage):
        for i in range(len(own)):
            said = ()
            for words in own[i:]:
                said += words
                if said == passage:
                    return True
        return False

    result = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        parsed = [blocks(r[2]) for r in mine]
        up = []
        for i, found in enumerate(parsed):
            quoted = [(d, sum(lines, ())) for d, lines in found if d]
            links = []
            for d, passage in quoted:
                origins = [j for j in range(i) if any(holds(lines, passage) for e, lines in parsed[j] if not e)]
                if origins:
                    links.append((d == 1, origins[-1]))
            up.append((len(quoted), len(links), max(links)[1] if links else (i - 1 if i else None), max([d for d, _ in found], default=0)))
        chain = []
        for i in range(len(mine)):
            chain.append(0 if up[i][2] is None else chain[up[i][2]] + 1)
        order = sorted(range(len(mine)), key=lambda i: (chain[i], i))
        for i, r in enumerate(mine):
            q, n, p, d = up[i]
            result[conv, r[1]] = (q, n, None if p is None else mine[p][1], d, order.index(i))
    return result


def _linked(llm, rows):
    df = llm.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash"))
    return df, {(r.conv_id, r.turn): r for r in chat.link_quotes(df).collect()}


def _figures(got):
    return {k: (r.n_quotes, r.n_linked, r.reply_to, r.quote_depth, r.position) for k, r in got.items()}


def test_quotes(llm):
    rows = [
        (1, 0, "Shall we meet\non Monday?\n\nBring the maps."),
        (1, 1, "> Shall we  MEET\n> on monday?\nYes."),
        (1, 2, "> Bring the maps.\nWhich ones?"),
        (1, 3, ">> Shall we meet\n>> on Monday?\n> Yes.\nGood."),
        (1, 4, "> > Bring the maps.\n> Which ones?\nAll of them"),
        (1, 5, "no quote"),
        (1, 6, "> never said\nHuh"),
        (2, 0, "> Yes.\nOther talk"),
        (2, 1, None),
        (2, 2, ""),
        (3, 7, "Yes."),
        # Some lines of a paragraph, two paragraphs joined, wrapped anew, half a line, across a quote.
        (4, 0, "one is here\ntwo is there\nthree is gone\n\nand a last line"),
        (4, 1, "something else"),
        (4, 2, "> two is there\nwhere?"),
        (4, 3, "> three is gone\n> and a last line\nno"),
        (4, 4, "> one is here two\n> is there\nlong ago"),
        (4, 5, "> is there\n>\n> > where?\nhalf"),
        (4, 6, "> long ago\n> half\nnot in one message"),
        (4, 7, "> something else\r> \r\nok"),
    ]
    df, got = _linked(llm, rows)
    assert _figures(got) == _brute_quotes(rows)
    assert [got[4, t].reply_to for t in (2, 3, 4, 5, 6, 7)] == [0, 0, 0, 2, 5, 1] and got[4, 6].n_linked == 0
    assert got[1, 3].own_text == "Good." and got[1, 3].reply_to == 1 and got[1, 4].reply_to == 2
    assert chat.link_quotes(df.limit(0)).count() == 0
    alone = chat.link_quotes(llm.createDataFrame([(None, 1, "a"), (None, None, "> a")], "conv_id long, turn long, text string")).collect()
    assert [(r.reply_to, r.position) for r in alone] == [(None, 0)] * 2


def test_quotes_made_of_turns(llm, sf_small):
    """Conversations whose turns quote lines of earlier ones, at random, against brute force."""
    rng, said, rows = random.Random(4), {}, []
    turns = [(r.conv_id % 12, r.text) for r in llm.read.parquet(f"{sf_small}/conversations.parquet").orderBy("conv_id", "turn").limit(150).collect()]
    for conv, text in turns:
        before, quote = said.setdefault(conv, []), []
        for _ in range(rng.randrange(4)):
            lines = [x for x in rng.choice(before).split("\n")] if before else ["nothing"]
            at = rng.randrange(len(lines))
            words = " ".join(lines[at : at + rng.randrange(1, 4)]).split() if rng.random() < 0.3 else None
            part = [" ".join(words[:3]), " ".join(words[3:])] if words else lines[at : at + rng.randrange(1, 4)]
            quote += ["> " * rng.randrange(1, 3) + x.upper() for x in part] + rng.choice([[], [""], ["aye"]])
        body = "\n".join(rng.choice([x.split(" ", 1)[0], x]) for x in (text or "").replace(". ", ".\n").split("\n"))
        rows.append((conv, len(before), "\n".join([*quote, body])))
        before.append(rows[-1][2])
    _, got = _linked(llm, rows)
    want = _brute_quotes(rows)
    assert _figures(got) == want and sum(w[1] for w in want.values()) > 60


def test_quotes_in_long_and_repeated_messages(llm):
    """A message of about 10 MB, one line of it quoted thousands of times; rows repeated as they are."""
    long = "\n".join(["so it goes on"] * 3000 + [f"line {i} of a very long message that goes on" for i in range(200_000)])
    rows = [(1, 0, long), (1, 1, "> line 150000 of a very long message that goes on\n> line 150001 of a very long message that goes on\nwhy")]
    rows += [(1, 2, "> so it goes on\n> so it goes on\nagain"), (1, 3, "> So\n> it goes on\n" * 2000)]
    _, got = _linked(llm, rows)
    assert [got[1, t].reply_to for t in range(4)] == [None, 0, 0, 0]
    assert all(got[1, t].n_linked == got[1, t].n_quotes == 1 for t in (1, 2, 3))
    again = chat.link_quotes(llm.createDataFrame([(1, 0, "a b"), (1, 0, "a b"), (1, 1, "> a b"), (1, 1, "> a b")], "conv_id long, turn long, text string")).collect()
    assert sorted((r.turn, r.n_linked, r.reply_to, r.position) for r in again if r.turn) == [(1, 1, 0, 2), (1, 1, 0, 3)] and len(again) == 4


def test_query_quotes(llm, sf_small):
    rows = [(r.conv_id, r.turn, r.text) for r in llm.read.parquet(f"{sf_small}/conversations.parquet").collect()]
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to, r.quote_depth, r.position) for r in QUERIES["op7_quote_linking"](llm, sf_small).collect()}
    assert got == _brute_quotes(rows)


# ------------------------------------------------------------------ pipeline


def test_stages_keep_the_columns(llm, odd):
    sf = scratch_path(llm, "odd")
    odd.write.parquet(f"{sf}/documents.parquet")
    llm.createDataFrame([(1, 1, 0), (7, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(llm, docs, sf).schema.names == docs.schema.names
        assert corpus_pipeline.STAGES[-1][1](llm, docs, sf).count() >= docs.count()


def test_pipeline(llm, sf_small):
    """What is left and packed is what a plain loop over the operators' own results leaves."""
    out = corpus_pipeline.run(llm, sf_small)
    scores = {r.doc_id: r.predicted for r in QUERIES["op6_noisy_channel_toxicity"](llm, sf_small).collect()}
    docs = llm.read.parquet(f"{sf_small}/documents.parquet")
    assert docs.schema.names == [c.split()[0] for c in DOC_SCHEMA.split(", ")]
    ids = [i for i, toxic in scores.items() if not toxic]
    clean = docs.filter(F.col("doc_id").isin(ids))
    good = {r.doc_id for r in corpus_pipeline.good_quality(llm, clean, sf_small).collect()}
    from .test_duplicates import _components

    sets = {}
    for r in docs.collect():
        if r.doc_id in good:
            words = (r.text or "").encode().lower().split()
            sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    order = sorted(sets)
    close = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    root = _components(order, [(a, b) for i, a in enumerate(order) for b in order[:i] if close(sets[a], sets[b])])
    assert any(len(sets[a] ^ sets[b]) for a, b in root.items())  # near copies, not only exact ones
    assert {r.doc_id for r in out.collect()} == set(root.values())
    assert len(ODD_ROWS) and out.agg(F.max("length")).first()[0] <= 4096
