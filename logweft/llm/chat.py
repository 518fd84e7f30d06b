"""Quotation linking: messages that quote one another become reply-ordered conversations without quotes.

Lines beginning with ">" marks are quotes, as deep as their marks. Runs of quote lines of one depth are passages.
A passage is normalised (case, white space) to its words, hashed, and joined with the stretches of whole lines of
earlier messages of the same conversation that have as many words; the message that holds it is what is
being answered. So a quote may be a message, a paragraph, some lines of one, or paragraphs without the blank line
between them, and may be wrapped anew.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import number_rows
from ..plans.scan import Scan, index_chunk, scan
from ..session import materialize

_MARKS = r"^(?:[ \t]*>)+"
_MARKED, _LINE_END = re.compile(_MARKS), re.compile("\r\n?|\n")

#: A stretch of words v1 .. vk has the hash v1 * BASE^(k-1) + .. + vk modulo PRIME, so the hash of any stretch
#: comes from those of two beginnings of the text.
PRIME, BASE = (1 << 61) - 1, 1_000_003_919_321
#: A passage is looked for where its first words are, so many at most.
ANCHOR_WORDS = 3
#: A beginning that many messages share is dealt over so many tasks.
SALTS = 32

_READ = (
    "conv string, n long, bounds array<struct<at: long, prefix: long>>, starts array<struct<at: long, prefix: long, anchor: long>>, "
    "quotes array<struct<start: int, depth: int, words: long, anchor: long, hash: long, power: long>>"
)


def _hash(values: list[int]) -> int:
    h = 0
    for v in values:
        h = (h * BASE + v) % PRIME
    return h


def _anchor(values: list[int]) -> int:
    return _hash(values) * 4 + len(values)


def read_message(text: str) -> tuple[list, list, list]:
    """Line bounds of the own text, places where a quoted passage may begin in it, and the passages it quotes.

    bounds: (at, prefix), words before and their hash. starts: (at, prefix, anchor). quotes: (line, depth, words,
    anchor, hash, BASE^words). Blank lines of own text do not count; quotes between own lines part them. Linear in the text.
    """
    values, prefix, bounds, quotes = [], 0, [], []
    run, first, deep, parted = [], 0, 0, True

    def close():
        if run:
            quotes.append((first, deep, len(run), _anchor(run[:ANCHOR_WORDS]), _hash(run), pow(BASE, len(run), PRIME)))
            run.clear()

    for number, line in enumerate(_LINE_END.split(text)):
        marks = _MARKED.match(line)
        depth = marks[0].count(">") if marks else 0
        rest = line[len(marks[0]) :] if marks else line
        words = [xxhash.xxh64_intdigest(w) % (PRIME - 1) + 1 for w in rest.lower().split()]
        if depth != deep or not words:
            close()
        if depth:
            if words and not run:
                first, deep = number, depth
            run += words
            parted = True
        elif words:
            deep = 0
            if parted:
                values.append(0)  # no word: no passage goes on across it
                prefix = prefix * BASE % PRIME
                bounds.append((len(values), prefix))
                parted = False
            for v in words:
                prefix = (prefix * BASE + v) % PRIME
            values += words
            bounds.append((len(values), prefix))
    close()
    ends, starts = {at for at, _ in bounds}, []
    for at, before in bounds:
        # A passage of fewer words than an anchor has ends where a line does.
        for k in range(1, ANCHOR_WORDS + 1):
            if at + k <= len(values) and (k == ANCHOR_WORDS or at + k in ends):
                starts.append((at, before, _anchor(values[at : at + k])))
    return bounds, starts, quotes


def read_messages(df: DataFrame) -> DataFrame:
    """``read_message`` of each row (conv, n, text)."""

    def run(batches):
        kinds = [
            pa.list_(pa.struct([("at", pa.int64()), ("prefix", pa.int64())])),
            pa.list_(pa.struct([("at", pa.int64()), ("prefix", pa.int64()), ("anchor", pa.int64())])),
            pa.list_(pa.struct([
                ("start", pa.int32()), ("depth", pa.int32()), ("words", pa.int64()),
                ("anchor", pa.int64()), ("hash", pa.int64()), ("power", pa.int64()),
            ])),
        ]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # the lists of a few messages at a time
                part = batch.slice(at, 500)
                read = list(zip(*[read_message(t) for t in part.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(read, kinds)]],
                    names=["conv", "n", "bounds", "starts", "quotes"],
                )

    return df.select("conv", "n", "text").mapInArrow(run, _READ)


def _held(read: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv, words, hash, n): stretches of whole own lines that begin like a passage quoted in the conversation and are as long.

    A place is tried with each length that passages with its beginning have: as many different lengths as the root of
    twice the words quoted, at most. The end must be a line's end, by an equality join of places.
    """
    wanted = quotes.select("conv", "anchor", "words", "power").distinct().withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    starts = read.select("conv", "n", F.explode("starts").alias("s")).select(
        "conv", "n", "s.*", F.pmod(F.xxhash64("n", "s.at"), F.lit(SALTS)).cast("int").alias("salt")
    )
    tried = starts.join(wanted, ["conv", "anchor", "salt"]).select(
        "conv", "n", "words", (F.col("at") + F.col("words")).alias("at"), F.col("prefix").alias("before"), "power"
    )
    ends = read.select("n", F.explode("bounds").alias("e")).select("n", "e.at", "e.prefix")
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  # products have up to 37 digits
    hashed = F.pmod(wide("prefix") - wide("before") * wide("power"), F.lit(PRIME).cast("decimal(19,0)")).cast("long")
    return tried.join(ends, ["n", "at"]).select("conv", "words", hashed.alias("hash"), "n")


def link_quotes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Stored table of all columns of ``df`` and: own_text, n_quotes, n_linked, reply_to, quote_depth, position.

    own_text: the text without quote lines, outer blank lines trimmed; null text counts as empty. n_quotes: quoted
    passages; n_linked: those whose words are those of consecutive whole lines of an earlier message of the conversation
    (blank lines and the breaks between lines do not count). reply_to: the turn answered,
    that is the latest message holding a passage quoted at depth 1, else at any depth, else null for the first
    message and the message before for others. quote_depth: deepest quote. position: place (from 0) in the
    conversation when every message follows the one it answers, ordered by the length of the reply
    chain, then turn. Rows of one conversation and turn are ordered by text; rows without a conversation are each
    alone (reply_to null, position 0). Names of results replace input columns.
    """
    new = ["own_text", "n_quotes", "n_linked", "reply_to", "quote_depth", "position"]
    names = [c for c in df.columns if c not in new]
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
        F.col(f"`{conv}`").cast("string").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    # Dense numbers in order of conversation and turn: the message before is the number before, with no window
    # over a conversation, which may hold a third of all rows.
    order = [F.col("conv"), F.col("turn"), F.xxhash64("text"), F.xxhash64(*[f"c{i}" for i in range(len(names))])]
    keyed = rows.withColumns({f"k{i}": c for i, c in enumerate(order)})
    messages = materialize(number_rows(keyed, [f"k{i}" for i in range(len(order))], "n").drop(*[f"k{i}" for i in range(len(order))]), "messages")
    read = materialize(read_messages(messages.filter("conv IS NOT NULL")), "read")
    quotes = read.select("conv", "n", F.explode("quotes").alias("q")).select("conv", "n", "q.*")
    # Each quote with the latest earlier message that holds its passage: one ordered scan per passage, in chunks,
    # so that a passage said and quoted thousands of times makes no pairs.
    key = ["conv", "words", "hash"]
    held = _held(read, quotes).select(*key, "n", F.lit(1).alias("own"), F.lit(0).alias("start"), F.lit(0).alias("depth"))
    marked = materialize(
        held.unionByName(quotes.select(*key, "n", F.lit(0).alias("own"), "start", "depth")).withColumn("chunk", index_chunk("n")), "passages"
    )
    linked = scan(
        marked, [Scan("origin", F.when(F.col("own") == 1, F.col("n")), "last", inclusive=False)],
        by=key, chunks=["chunk"], order=["n", "own", "start"],
    ).filter((F.col("own") == 0) & F.col("origin").isNotNull())
    per_message = linked.groupBy("n").agg(
        F.count("*").alias("n_linked"),
        F.max(F.struct((F.col("depth") == 1).alias("direct"), "origin"))["origin"].alias("origin"),
    )
    quoted = quotes.groupBy("n").agg(F.count("*").alias("n_quotes"), F.max("depth").alias("quote_depth"))
    narrow = messages.select("n", "conv", "turn")
    before = narrow.select((F.col("n") + 1).alias("n"), F.col("conv").alias("__conv"))
    replies = materialize(
        narrow.join(before, "n", "left").join(per_message, "n", "left").join(quoted, "n", "left").select(
            "n", "conv", "turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
            F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"),
            F.coalesce("origin", F.when(F.col("conv") == F.col("__conv"), F.col("n") - 1)).alias("parent"),
        ),
        "replies",
    )
    placed = _positions(replies, _depths(replies))
    parent = narrow.select(F.col("n").alias("parent"), F.col("turn").alias("reply_to"))
    own_lines = F.filter(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), lambda x: ~F.rlike(x, F.lit(_MARKS)))
    return (
        messages.join(placed, "n").join(parent, "parent", "left").select(
            *[F.col(f"c{i}").alias(c) for i, c in enumerate(names)],
            F.regexp_replace(F.concat_ws("\n", own_lines), r"^\s+|\s+$", "").alias("own_text"),
            "n_quotes", "n_linked", "reply_to", "quote_depth", "position",
        )
    )


def _depths(replies: DataFrame) -> DataFrame:
    """(n, depth): length of each message's reply chain, by pointer doubling; log2(longest chain) rounds.

    Only messages whose chain has not ended yet go into a round, so that one long conversation
    does not make all others be joined again.
    """
    start = materialize(
        replies.select("n", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").alias("up")), "chain"
    )
    ended, going = [start.filter("up IS NULL")], start.filter("up IS NOT NULL")
    while not going.isEmpty():
        everything = reduce(DataFrame.unionByName, [*ended, going])
        above = everything.select(F.col("n").alias("up"), F.col("depth").alias("__more"), F.col("up").alias("__up"))
        step = going.join(above, "up").select("n", (F.col("depth") + F.col("__more")).alias("depth"), F.col("__up").alias("up"))
        step = materialize(step, "chain")
        ended.append(step.filter("up IS NULL"))
        going = step.filter("up IS NOT NULL")
    return reduce(DataFrame.unionByName, ended).select("n", "depth")


def _positions(replies: DataFrame, depths: DataFrame) -> DataFrame:
    """Place of each message in its conversation: running numbers over all, less the conversation's first."""
    keyed = replies.join(depths, "n")
    numbered = number_rows(keyed, ["conv", "depth", "n"], "place")
    first = numbered.groupBy("conv").agg(F.min("place").alias("__first"))
    return numbered.join(first, "conv", "left").select(
        "n", "parent", "n_quotes", "n_linked", "quote_depth",
        F.when(F.col("conv").isNull(), 0).otherwise(F.col("place") - F.col("__first")).cast("long").alias("position"),
    )
