"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most two bits,
one half differs in at most one; with that bit blanked out (one wildcard) the halves are equal. Every
distinct fingerprint is indexed under the 32 one-wildcard variants of each half; equal
variants are joined and the whole fingerprints compared. Copies share a fingerprint and are
one node, so that a group of copies costs one row.

``keep_one`` asks for a Jaccard similarity of shingles instead, which two bits of 64 do not reach. Its wider
fingerprint is cut into segments of several lanes, each the least hash of all shingles; texts
that share a segment but for one deleted lane are candidates, compared by their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, shuffled
from .common import add_columns, components, forget, may_be_in, rows_in, texts_of

SEED, SHINGLE, DISTANCE = 42, 3, 2
_LANES = np.uint64(0x0101010101010101)
#: The rule of ``keep_one``: words of a shingle, and the least similarity of two texts.
JACCARD_SHINGLE, SIMILARITY = 5, 0.8
#: The wider fingerprint. Two texts of similarity 0.8 share no variant with a chance of 3 in a million
#: ((1 - 0.8^6 - 6 * 0.2 * 0.8^5) ^ 12), more similar ones with less.
SEGMENTS, SEGMENT_LANES = 12, 6
_CONSTANTS = np.random.default_rng(SEED).integers(0, 1 << 64, (4, SEGMENTS * SEGMENT_LANES), np.uint64) | np.uint64(1)


def _hashes(words: list[bytes], shingle: int, seed: int = SEED) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, len(words) - shingle + 1)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each is 1 if set in over half of the hashes of the shingles, repeats included.

    A-Z are lower-cased, words are separated by ASCII white space. Fewer words than a shingle: the
    whole sequence is the one shingle; no words: zero.
    """
    hashes = _hashes(text.lower().split(), shingle, seed)
    n = len(hashes)
    if not n:
        return 0
    starts = np.arange(0, n, 255)  # a byte lane counts to 255
    out = 0
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)  # of the bits k, 8 + k, ...
        for lane in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * lane + k)
    return out


def add_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Add the fingerprint (long) of every whole text; null counts as empty."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        fps = np.array([fingerprint(t, shingle) for t in texts_of(batch, text)], np.uint64)
        return [pa.array(fps.view(np.int64))]

    return add_columns(df, f"`{out}` long", make)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints ``fp`` that differ in at most ``distance`` (0 to 2) bits, each once."""
    if not 0 <= distance <= 2:
        raise ValueError("two halves hold for up to two differing bits; more need more segments")
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    n = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("n")  # half, then the wildcard's place
    wildcard = F.expr("shiftleft(1L, n % 32)")
    half = F.when(F.col("n") < 32, F.col("high")).otherwise(F.col("low"))
    index = fps.select("fp", high.alias("high"), low.alias("low"), n).select(
        "fp", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(half.bitwiseAND(F.bitwise_not(wildcard))).alias("key")
    )
    a, b = index.select("key", F.col("fp").alias("a")), index.select("key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    high_differ, place = F.shiftrightunsigned(differ, 32), F.shiftright("key", 32)
    in_high = F.bit_count(high_differ) <= 1
    own = F.when(in_high, high_differ).otherwise(differ.bitwiseAND(F.lit(0xFFFFFFFF)))
    # A pair may share many keys; it counts at the first half that fits, equal halves at their first place.
    once = ((place < 32) == in_high) & ((own != 0) | (place % 32 == 0))
    close = F.bit_count(differ) <= distance
    # 64 rows for each fingerprint of a small file: by shuffle, Spark would broadcast them.
    same = (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b"))
    return shuffled(a).join(b.withColumnRenamed("key", "key_b"), same & once & close).select("a", "b")


def fingerprint_groups(rows: DataFrame, value: str, distance: int = DISTANCE) -> DataFrame:
    """(fp, lowest): for each distinct ``fp`` of the stored ``rows`` the smallest ``value`` in its component."""
    fps = materialize(rows.groupBy("fp").agg(F.min(value).alias("own")), "fingerprints")
    found = components(links(fps.select("fp"), distance), "fingerprint-links")
    member = fps.join(shuffled(found), fps["fp"] == found["node"], "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root")
    )
    lowest = member.groupBy("root").agg(F.min("own").alias("lowest"))
    return member.join(shuffled(lowest), "root").select("fp", "lowest")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id each document can reach over links of fingerprints.

    Empty and null texts have fingerprint zero and are linked like any other. A null id never is
    the smallest unless a component has no other. Every input row, repeated ones too, gives one row.
    """
    base = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = materialize(add_fingerprints(base).select("id", "fp"), "simhash")
    groups = fingerprint_groups(rows, "id", distance)
    return rows.join(shuffled(groups), "fp").select(
        F.col("id").alias(id_column), hex16(F.col("fp")).alias("fingerprint"), F.col("lowest").alias("component_id")
    )


def least_lanes(hashes: np.ndarray) -> np.ndarray:
    """The wider fingerprint of a text: for each lane the least of its function of the hashes of all shingles."""
    times, plus = _CONSTANTS[:2]
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * times + plus).min(axis=0), out=least)
    return least ^ (least >> np.uint64(29))


def variants(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketch): the wider fingerprint under its one-lane deletions, a key for each segment and deleted lane, and
    a byte of each lane, eight to a number. No keys without shingles."""
    lanes = least_lanes(hashes)
    sketch = (lanes & np.uint64(0xFF)).astype(np.uint8).view(np.uint64)
    if not len(hashes):
        return np.zeros(0, np.uint64), sketch
    weight, own = _CONSTANTS[2:]
    weighted = (lanes * weight).reshape(SEGMENTS, SEGMENT_LANES)
    return (weighted.sum(axis=1, keepdims=True, dtype=np.uint64) - weighted).ravel() + own, sketch


#: Numbers of a sketch, and the least lanes of it that texts of similarity 0.8 have in common: 57.6 of 72 are expected, and
#: fewer than 44 come with a chance of one in ten thousand (two in ten million at a similarity of 0.85).
_SKETCH, LEAST_LANES = SEGMENTS * SEGMENT_LANES // 8, 44
#: Rounds of comparing with one node of each key.
ROUNDS = 3


def _fits(a: Column, b: Column, similarity: float) -> Column:
    """Sets of these sizes can be as similar."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - 1e-6


def _alike(a: Callable[[int], Column], b: Callable[[int], Column]) -> Column:
    """Whether two sketches have enough lanes in common."""
    differ = []
    for i in range(_SKETCH):
        x = a(i).bitwiseXOR(b(i))
        for shift in (4, 2, 1):  # the lowest bit of a byte becomes 1 if any of its bits is
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ.append(F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    return sum(differ[1:], differ[0]) <= SEGMENTS * SEGMENT_LANES - LEAST_LANES


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose shingle sets have at least this Jaccard similarity; compared one pair at a time."""
    left, right = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    close = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - 1e-9
    return pairs.join(left, "a").join(right, "b").filter(close).select("a", "b")


def _sets(texts: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes in the arrays ``nodes`` of the stored ``named``, and of a few others, which joins leave out.

    Texts stay where they are, however many are named."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        flat, ends = [np.zeros(0, np.uint64)], [0]
        for t in texts_of(batch):
            flat.append(np.unique(_hashes(t.lower().split(), shingle)))
            ends.append(ends[-1] + len(flat[-1]))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))]

    nodes = named.select(F.explode("nodes").alias("node"))
    wanted = may_be_in(texts, "node", nodes, "__wanted").filter("__wanted").select("node", "text")
    return add_columns(wanted, "shingles array<long>", make).select("node", "shingles")


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def similar_links(index: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = JACCARD_SHINGLE) -> DataFrame:
    """Edges (a, b) that join the same nodes as all pairs of texts of this similarity that share a variant.

    ``index``: (node, size, keys, sketch), stored: the texts' shingles counted, their variants and a byte of each lane;
    ``texts``: (node, text). In ``ROUNDS`` rounds each key names one of its nodes, and those that are not in its component yet
    are compared with it: first the node that shares its keys with most others, which is near the middle of a group
    of near copies, then others by a hash, the same for many keys. So dense groups are joined without making their pairs.
    Nodes under keys that still hold several components meet if they share a rare shingle (``_sharing_rare``). A pair is
    a candidate if sizes and sketches allow the similarity, and is then compared by its whole sets.
    """
    exploded = index.select("node", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    near = materialize(exploded.join(shared, "key"), "similar-keys")
    hubs = near.groupBy("node").agg(F.sum("n").alias("hub"))
    member = materialize(near.join(hubs, "node").select("key", "node", "n", "hub", F.col("node").alias("root")), "similar-members")
    about = index.select("node", "size", "sketch")
    compared = linked = None

    def exact(pairs: DataFrame) -> DataFrame:
        sets = _sets(texts, pairs.select(F.array("a", "b").alias("nodes")), shingle)
        return _similar(pairs, materialize(sets, "similar-sets"), similarity)

    def side(name: str) -> DataFrame:
        return about.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("sketch").alias(f"sketch_{name}"))

    lane = lambda c: lambda i: F.col(c)[i]
    for turn in range(ROUNDS):
        by = F.struct("hub", F.hash("node")) if turn == 0 else F.struct(F.xxhash64("node", F.pmod("key", F.lit(3)), F.lit(turn)))
        named = member.groupBy("key").agg(F.max_by(F.struct("node", "root"), by).alias("named"))
        met = member.join(named, "key").filter(F.col("root") != F.col("named.root")).select(*_pairs(F.col("node"), F.col("named.node"))).distinct()
        if compared is not None:
            met = met.join(compared, ["a", "b"], "left_anti")
        met = met.join(side("a"), "a").join(side("b"), "b")
        met = met.filter(_fits(F.col("size_a"), F.col("size_b"), similarity) & _alike(lane("sketch_a"), lane("sketch_b"))).select("a", "b")
        met = materialize(met, "similar-pairs")
        compared = met if compared is None else compared.unionByName(met)
        found = materialize(exact(met), "similar-links")
        linked = found if linked is None else linked.unionByName(found)
        root = components(linked, "similar-components")
        member = member.drop("root").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = member.groupBy("key").agg(F.min("root").alias("__min"), F.max("root").alias("__max")).filter("__min < __max").select("key")
        member = materialize(member.join(apart, "key", "left_semi"), "similar-members")

    nodes = materialize(member.select("node", "root").distinct(), "similar-left")
    sets = materialize(_sets(texts, nodes.select(F.array("node").alias("nodes")), shingle), "similar-sets")
    met = _sharing_rare(sets.join(nodes, "node"), similarity).join(compared, ["a", "b"], "left_anti")
    met = met.join(side("a"), "a").join(side("b"), "b").filter(_alike(lane("sketch_a"), lane("sketch_b"))).select("a", "b")
    return linked.unionByName(_similar(materialize(met, "similar-rest"), sets, similarity))


def _sharing_rare(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the stored ``sets`` (node, root, shingles), of different roots, that can be as similar by their rare shingles.

    Prefix filtering: order shingles by how many sets hold them. Two sets of this similarity, the smaller one x, have in
    common at least 2s / (1 + s) of x and s of y; so one of the rest of x and one of the rest of y (and one more each), taken from
    the rare end, are the same. Sets that share a frequent passage but have too much of their own never meet.
    """
    size = F.size("shingles")
    tokens = sets.select("node", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    # Shingles of one set come first in its order and meet nothing: their number is enough.
    listed = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("l"))
    listed = sets.select("node", "root", size.alias("size")).join(listed, "node").withColumn("alone", F.col("size") - F.size("l"))

    def prefix(share: float, name: str) -> DataFrame:
        most = (F.col("size") - F.ceil(F.col("size") * F.lit(share) - 1e-9) + 1 - F.col("alone")).cast("int")
        first = F.slice("l", F.lit(1), F.greatest(most, F.lit(0)))
        rows = listed.select(
            *[F.col(c).alias(f"{name}_{c}") for c in ("node", "root", "size")], "alone", F.posexplode(F.transform(first, lambda t: t["token"])).alias("at", "token")
        )
        return rows.withColumn(f"{name}_left", F.col(f"{name}_size") - F.col("alone") - F.col("at")).drop("alone", "at")

    x, y = prefix(2 * similarity / (1 + similarity), "x"), prefix(similarity, "y")
    smaller = F.struct("x_size", "x_node") < F.struct("y_size", "y_node")
    # Up to their first common shingle nothing is common, so that what is left must be enough; later ones need not tell.
    enough = F.least("x_left", "y_left") >= F.lit(similarity / (1 + similarity)) * (F.col("x_size") + F.col("y_size")) - 1e-6
    both = x.join(y, "token").filter(enough & smaller & (F.col("x_root") != F.col("y_root")) & _fits(F.col("x_size"), F.col("y_size"), similarity))
    return both.select(*_pairs(F.col("x_node"), F.col("y_node"))).distinct()


def keep_one(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shingle: int = JACCARD_SHINGLE
) -> DataFrame:
    """``df`` with one row of every component: that of the smallest id, the first of repeated rows.

    Texts are linked if the Jaccard similarity of their sets of shingles (words as in ``fingerprint``) is at least
    ``similarity``, which must not be below that the variants are laid out for. All columns stay. The rows are numbered and
    written once, so that repeated ids and null ids are told apart; a row with a null id stays
    only in a component without ids. Texts of the same words are one node.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError(f"the variants find texts of a similarity of {SIMILARITY} to 1")
    names = df.columns
    renamed = df.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("text")
    )

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        forget()
        # Batches of a task are numbered in turn; the numbers are kept by the written table.
        task = TaskContext.get()
        first = _NUMBERS.get(task.taskAttemptId(), task.partitionId() << 36)
        _NUMBERS.clear()
        _NUMBERS[task.taskAttemptId()] = first + batch.num_rows
        digests, sizes, keys, sketches = [], [], [], []
        for t in texts_of(batch):
            words = t.lower().split()
            hashes = np.unique(_hashes(words, shingle))
            digests.append(xxhash.xxh128_digest(b" ".join(words), SEED))
            sizes.append(len(hashes))
            own, sketch = variants(hashes)
            keys.append(own.view(np.int64))
            sketches.append(sketch.view(np.int64))
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *keys])
        return [
            pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            pa.array(np.arange(first, first + batch.num_rows)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(sketches) + 1, dtype=np.int32) * _SKETCH), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches]))),
        ]

    made = add_columns(renamed, "digest binary, size long, keys array<long>, row long, sketch array<long>", make)
    stored = materialize(made.drop("text"), "simhash-rows")
    key = f"c{names.index(id_column)}"
    # Smallest id, nulls last, then the first row.
    own = F.struct(F.col(key).isNull(), F.col(key), F.col("row"))
    nodes = materialize(stored.groupBy("digest").agg(F.min(own).alias("own"), F.min("row").alias("node")).drop("digest"), "simhash-nodes")
    copies = materialize(stored.select(F.col("row").alias("node")).join(nodes, "node", "left_anti"), "simhash-copies")
    index = stored.select(F.col("row").alias("node"), "size", "keys", "sketch")
    index = materialize(rows_in(index, "node", nodes.select("node"), copies), "simhash-index")
    texts = stored.select(F.col("row").alias("node"), F.col(f"c{names.index(text)}").cast("string").alias("text"))
    found = components(similar_links(index, texts, similarity, shingle), "similar-components")
    lowest = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("own").alias("lowest"))
    kept = materialize(lowest.select(F.col("lowest")["row"].alias("row")), "simhash-kept")
    dropped = materialize(stored.select("row").join(kept, "row", "left_anti"), "simhash-dropped")
    whole = stored.select("row", *[f"c{i}" for i in range(len(names))])
    return rows_in(whole, "row", kept, dropped).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


_NUMBERS: dict[int, int] = {}
