"""SimHash fingerprints of documents and the search for all near ones, in DataFrame functions only.

The terms of a text are its words and its pairs of neighbouring words. Each occurrence of a term votes with the
term's 64 hash bits, for a bit if it is set and against it if not, as often as the term weighs (its characters, since
longer terms are rarer; pairs so count more than words). A bit of the fingerprint is 1 if the votes for it
outweigh. One sum counts two bits, in the two halves of a long.

Search: the fingerprint is cut into ``BLOCKS`` blocks. Of two fingerprints that differ in at most ``RADIUS`` bits,
BLOCKS - RADIUS blocks are equal, so a table for each choice of as many blocks, keyed by them with the others
permuted behind, has both under one key. Equal fingerprints are one row. Under each key all are compared
with the least one, which joins dense groups without making their pairs; only members of keys under which that leaves
different components are compared with the rest of their key, which is held in slices of about ``SLICE`` fingerprints.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import number_rows
from ..session import materialize
from .common import components

BLOCKS, RADIUS = 6, 3
#: Fingerprints of one key that are held together.
SLICE = 512
_BITS = 64
_BLANK, _BLANKS = " \t\n\x0b\f\r", "[ \\t-\\r]+"


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp): the fingerprint (long) of the text of each group of ``keys``, which should be one row.

    No words: no votes, fingerprint zero. If ``df`` is dealt out by the keys, or some of them, nothing is shuffled.
    """
    words = F.split(F.btrim(F.lower(text), F.lit(_BLANK)), _BLANKS)
    listed = df.select(*keys, words.alias("w")).select(*keys, "w", F.slice("w", F.lit(2), F.size("w")).alias("v"))
    terms = listed.select(*keys, F.inline(F.arrays_zip("w", "v")))
    votes = F.col("h"), F.col("g")
    hashed = terms.select(
        *keys, F.xxhash64("w").alias("h"), F.xxhash64("w", "v").alias("g"), F.length("w").cast("long").alias("m"),
        F.coalesce(F.length("w") + F.length("v"), F.lit(0)).cast("long").alias("n"),
    )
    two = F.lit((1 << 32) + 1)  # one bit in each half
    half = _BITS // 2
    sums = [
        F.sum(F.shiftrightunsigned(votes[0], i).bitwiseAND(two) * F.col("m") + F.shiftrightunsigned(votes[1], i).bitwiseAND(two) * F.col("n")).alias(f"s{i}")
        for i in range(half)
    ]
    counted = hashed.groupBy(*keys).agg(*sums, F.sum(F.col("m") + F.col("n")).alias("all"))
    low = F.lit((1 << 32) - 1)

    def bit(i: int) -> Column:
        total = F.col(f"s{i % half}")
        ones = F.shiftrightunsigned(total, 32) if i >= half else total.bitwiseAND(low)
        return F.when(ones * 2 > F.col("all"), F.lit(1 << i if i < _BITS - 1 else -(1 << 63))).otherwise(F.lit(0)).cast("long")

    parts = [bit(i) for i in range(_BITS)]
    while len(parts) > 1:
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2])]
    return counted.select(*keys, parts[0].alias("fp"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(_BITS))


def _masks(blocks: int, radius: int) -> list[int]:
    """For each table the bits of its key."""
    edges = [i * _BITS // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def groups(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root) for the stored distinct fingerprints ``fp``: the least one reachable over links of at most ``radius`` bits.

    Fingerprints without a link to another are their own root.
    """
    if not 0 <= radius < blocks <= _BITS:
        raise ValueError("needs more blocks than differing bits")
    masks = F.array(*[F.lit(m) for m in _masks(blocks, radius)])
    tables = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    least = tables.groupBy("t", "key").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    held = materialize(tables.join(least, ["t", "key"]), "fingerprint-tables")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    first = held.filter((F.col("fp") != F.col("least")) & near(F.col("fp"), F.col("least"))).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    first = materialize(first.distinct(), "fingerprint-links")
    root = components(first, "fingerprint-components")
    member = held.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("t", "key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "fingerprint-members")
    apart = member.groupBy("t", "key").agg(F.min("root").alias("own"), F.max("root").alias("__max")).filter("own < __max").drop("__max")
    member = member.join(apart, ["t", "key"]).withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int"))
    sliced = member.groupBy("t", "key", F.pmod(F.hash("fp"), "slices").alias("slice")).agg(F.collect_list(F.struct("fp", "root")).alias("others"))
    # Of two components under a key one is not that of the least root; its members do the asking.
    asking = member.filter("root <> own").select("t", "key", "fp", "root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    found = asking.join(sliced, ["t", "key", "slice"]).select(
        F.col("root").alias("a"),
        F.explode(F.array_distinct(F.transform(
            F.filter("others", lambda o: (o["root"] != F.col("root")) & near(o["fp"], F.col("fp"))), lambda o: o["root"]
        ))).alias("b"),
    )
    links = first.unionByName(materialize(found.distinct(), "fingerprint-links"))
    final = components(links, "fingerprint-components")
    return fps.join(final.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


@contextmanager
def _fused(spark: SparkSession):
    """Joining, cutting and voting make one long stage; taken apart by the usual limit of generated code it takes twice as long."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "65535")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _keyed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    base = df.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ident = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("-"))
    return base.select("id", ident.alias("ident"), F.xxhash64("text").alias("digest"), "text")


def compare_edited(df: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with their likeness, and the components of near fingerprints.

    Edited: the last floor(n_chars / 4) characters give way to the first as many (or all) of the next row's text in order of
    id, null first, then of a hash of the text; behind the last row is the first. ``component_id`` is the smallest id (null
    only if there is no other) that can be reached over fingerprints at most ``radius`` bits apart. A null text is empty; empty
    texts have fingerprint zero and are linked like any other. Every row, repeated ones too, gives one row: of equal
    rows all but one are followed by their own text. Whole texts are shuffled once, beginnings of texts once more.
    """
    keys = ["ident", "digest"]
    rows = _keyed(df, id_column, text)
    small = rows.groupBy(*keys, "id").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    small = materialize(number_rows(materialize(small, "fingerprint-rows"), ["id", *keys], "place"), "fingerprint-places")
    many = small.count()
    after = small.select(
        F.pmod(F.col("place") - 1, F.lit(max(many, 1))).alias("place"), F.col("ident").alias("next_ident"), F.col("digest").alias("next_digest")
    )
    small = materialize(small.join(after, "place").withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int")), "fingerprint-order")
    gives = small.select(F.col("next_ident").alias("ident"), F.col("next_digest").alias("digest"), F.col("ident").alias("to_ident"), F.col("digest").alias("to_digest"), "quarter")

    texts = rows.groupBy(*keys).agg(F.first("text").alias("text"))  # equal rows are put together before the shuffle
    given = texts.join(gives, keys).select(
        F.col("to_ident").alias("ident"), F.col("to_digest").alias("digest"), F.left("text", F.col("quarter")).alias("given")
    )
    both = texts.join(small.select(*keys, "n_chars", "quarter", "copies"), keys).join(given, keys)
    kept = F.left("text", (F.col("n_chars") - F.col("quarter")).cast("int"))
    edited, by_itself = F.concat(kept, "given"), F.concat(kept, F.left("text", F.col("quarter")))
    # The digest is made here, once a text; made behind the array it would be worked out again for every word.
    piece = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"), F.sha2(t, 256).alias("sha"))
    pieces = F.array_compact(F.array(piece(0, F.col("text")), piece(1, edited), F.when(F.col("copies") > 1, piece(2, by_itself))))
    told = both.select(*keys, F.inline(pieces))
    with _fused(df.sparkSession):
        made = materialize(fingerprints(told, [*keys, "kind", "sha"]), "fingerprints")

    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = made.groupBy(*keys).agg(
        of(0, "fp").alias("fp"), of(1, "fp").alias("fp1"), of(1, "sha").alias("sha1"), of(2, "fp").alias("fp2"), of(2, "sha").alias("sha2")
    )
    wide = materialize(small.drop("place", "quarter").join(wide, keys), "fingerprint-wide")
    nodes = wide.groupBy("fp").agg(F.min("id").alias("own"))
    nodes = materialize(nodes, "fingerprint-nodes")
    root = materialize(groups(nodes.select("fp"), radius, blocks), "fingerprint-groups")
    lowest = nodes.join(root, "fp").groupBy("root").agg(F.min("own").alias("component_id"))
    named = root.join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    beside = wide.select(F.col("ident").alias("next_ident"), F.col("digest").alias("next_digest"), F.col("fp").alias("next_fp"))
    joined = wide.join(beside, ["next_ident", "next_digest"]).join(named, F.col("fp") == F.col("of"))
    last = F.col("copy") == F.col("copies")
    out = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    edited_fp = F.when(last, F.col("fp1")).otherwise(F.col("fp2"))
    return out.select(
        F.col("id").alias(id_column), "n_chars", F.when(last, F.col("sha1")).otherwise(F.col("sha2")).alias("edited_sha256"),
        hex16(F.col("fp")).alias("fingerprint"), hex16(edited_fp).alias("edited_fingerprint"),
        likeness(F.col("fp"), edited_fp).alias("near_edited"),
        F.when(last, likeness(F.col("fp"), F.col("next_fp"))).otherwise(F.lit(1.0)).alias("near_next"), "component_id",
    )
