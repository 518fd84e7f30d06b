"""Near-duplicate vectors by product quantisation, without losing links.

Distinct vectors of unit length lie in coarse inverted lists (nearest centroid); the residual to the
centroid is coded by its nearest codeword in each subspace. A vector probes every list that can
hold a partner: two vectors with cosine >= t are at most r = sqrt(2 - 2t) apart, so a partner is in a list
only if the plane between the two centroids is at most r away. In a list the asymmetric distance
(exact query, coded member, summed from lookup tables) may be off by the member's coding error,
which is stored; what it cannot rule out is compared exactly in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import components

#: Centroids and codebooks are fitted on at most so many vectors, in the order of a hash of their ids.
TRAIN_VECTORS = 20_000
SUBSPACES, CODEWORDS = 8, 64
#: Lists: LISTS_FACTOR * sqrt(vectors), at most MAX_LISTS, so that probing a vector stays cheap.
LISTS_FACTOR, MAX_LISTS = 0.25, 4_096
#: Members and queries of one task's block, at most about: one list may hold a third of all vectors.
BLOCK = 4_096
SLACK = 1e-5


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Plain Lloyd iterations from evenly spaced rows; empty clusters keep their centre."""
    k = max(1, min(k, len(x)))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1)


class Codebook:
    def __init__(self, sample: np.ndarray, n_lists: int, subspaces: int, codewords: int):
        self.centres = _kmeans(sample, n_lists)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.words = [_kmeans(rest[:, p], codewords) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, coding error) of each row."""
        lists = _nearest(x, self.centres)
        rest = x - self.centres[lists]
        codes = np.stack([_nearest(rest[:, p], w) for p, w in zip(self.parts, self.words)], axis=1).astype(np.uint8)
        coded = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)
        return lists, codes, np.sqrt(((rest - coded) ** 2).sum(1))

    def probes(self, x: np.ndarray, lists: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): every list that can hold a vector at most ``reach`` away."""
        d = ((x**2).sum(1)[:, None] + (self.centres**2).sum(1)[None]) - 2 * x @ self.centres.T
        apart = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(2), 1e-24))
        plane = (d - d[np.arange(len(x)), lists][:, None]) / (2 * apart[lists])
        return np.nonzero(plane <= reach + SLACK)

    def distances(self, x: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of the queries ``x`` to coded members of one list, from lookup tables."""
        rest = x - self.centres[centre]
        total = np.zeros((len(x), len(codes)), np.float32)
        for i, (p, w) in enumerate(zip(self.parts, self.words)):
            table = ((rest[:, p][:, None] - w[None]) ** 2).sum(2).astype(np.float32)
            total += table[:, codes[:, i]]
        return total


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # squares of extreme components neither overflow nor vanish
    x = x / big
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component among nodes 0 to n - 1 linked by (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_vectors(
    df: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    train_vectors: int = TRAIN_VECTORS,
) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at
    least ``threshold``. Rows with a null label or id, or a vector that is null, empty, zero or holds null or
    non-finite components, link with nothing: 0, their own id, kept. Vectors of different lengths
    never link. Equal vectors under one label are compared once and counted as often as they occur; of
    rows that share an id each gets its own row. An empty table gives an empty result.
    """
    base = df.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    )
    big = F.array_max(F.transform("vector", F.abs))  # null in, NaN and infinity come out largest
    good = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
        & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (big > 0)
    )
    rows = materialize(
        base.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("key", F.when(F.col("good"), F.xxhash64("label", "vector"))), "vectors"
    )
    # One row for equal vectors; the node number is kept by the written table.
    nodes = materialize(
        rows.filter("good").groupBy("key", "label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        .withColumn("dim", F.size("vector")).withColumn("node", F.monotonically_increasing_id()),
        "vector-nodes",
    )
    n = nodes.count()
    parts = [_links(nodes.filter(F.col("dim") == r["dim"]), threshold, train_vectors) for r in nodes.select("dim").distinct().collect()]
    own = rows.filter("NOT good").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
    )
    if n == 0:
        return _named(own, id_column)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = materialize(found, "vector-links")  # node, links to other nodes' rows, root inside the block
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    member = nodes.join(links, "node", "left").join(roots, "node", "left").select(
        "key", "label", "vector", "id", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    lowest = member.groupBy("root").agg(F.min("id").alias("component_id"))
    member = member.join(lowest, "root").select("key", "label", "vector", "n_links", "component_id")
    joined = rows.filter("good").join(member, ["key", "label", "vector"]).select(
        "id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
    return _named(joined.unionByName(own), id_column)


def _named(df: DataFrame, id_column: str) -> DataFrame:
    return df.select(F.col("id").alias(id_column), "n_links", "component_id", "kept")


def _links(nodes: DataFrame, threshold: float, train_vectors: int) -> DataFrame:
    """(node, links, root) for vectors of one length: one or more rows for each node that has a link."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("id"), "node").limit(train_vectors).select("vector").toArrow()  # bounded by train_vectors
    book = Codebook(_unit(_vectors(sample["vector"])), min(MAX_LISTS, math.ceil(LISTS_FACTOR * math.sqrt(n))), SUBSPACES, CODEWORDS)

    def index(batches):
        for batch in batches:
            x = _unit(_vectors(batch.column(1)))
            lists, codes, error = book.encode(x)
            row, probe = book.probes(x, lists, reach)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)), pa.array(probe.astype(np.int32))),
                ],
                names=["node", "vector", "label", "copies", "list", "codes", "error", "probes"],
            )

    indexed = materialize(
        nodes.select("node", "vector", "label", "copies").mapInArrow(
            index, "node long, vector array<double>, label string, copies long, list int, codes binary, error double, probes array<int>"
        ),
        "vector-index",
    )
    # Blocks of a list: members by queries. Sizes come from counts, one row per label and list.
    members = indexed.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m_blocks"))
    asking = indexed.select("label", F.explode("probes").alias("list")).groupBy("label", "list").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("q_blocks")
    )
    sizes = materialize(members.join(asking, ["label", "list"]), "vector-blocks")
    side = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    def blocks(table: DataFrame, own: str, other: str) -> DataFrame:
        dealt = table.join(sizes, ["label", "list"]).withColumn("blocks", F.col(f"{own}_blocks")).withColumn(own, side)
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))

    key = ["label", "list", "m", "q"]
    member = blocks(indexed.select("label", "list", "node", "vector", "copies", "codes", "error"), "m", "q")
    query = blocks(indexed.select("label", F.explode("probes").alias("list"), "node", "vector"), "q", "m")
    member = member.select(*key, "node", "vector", "copies", "codes", "error")
    query = query.select(*[F.col(c).alias(f"q_{c}") for c in (*key, "node", "vector")])

    def compare(group, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            centre = group[1].as_py()
            y, copies, error = _vectors(left["vector"]), left["copies"].to_numpy(), left["error"].to_numpy()
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(y), -1)
            ids, all_queries, q_ids = left["node"].to_numpy(), _vectors(right["q_vector"]), right["q_node"].to_numpy()
            y = _unit(y)
            limit = ((reach + error + SLACK) ** 2 + SLACK).astype(np.float32)
            links, from_, to_ = np.zeros(len(q_ids), np.int64), [], []
            for at in range(0, len(q_ids), 512):
                x = _unit(all_queries[at : at + 512])
                i, j = np.nonzero(book.distances(x, centre, codes) <= limit[None])
                other = q_ids[at + i] != ids[j]
                i, j = i[other], j[other]
                close = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
                i, j = i[close], j[close]
                links[at : at + 512] += np.bincount(i, weights=copies[j], minlength=len(x)).astype(np.int64)
                from_.append(q_ids[at + i])
                to_.append(ids[j])
            a, b = np.concatenate(from_), np.concatenate(to_)
            if len(a):
                # Enough edges to keep the block's components together, not one for each link.
                names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = _roots(where[: len(a)], where[len(a) :], len(names))
                has = np.flatnonzero(links)
                out = (
                    np.concatenate([q_ids[has], names]), np.concatenate([links[has], np.zeros(len(names), np.int64)]),
                    np.concatenate([q_ids[has], names[root]]),
                )
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["node", "links", "root"])

    return member.groupBy(*key).cogroup(query.groupBy(*[f"q_{c}" for c in key])).applyInArrow(compare, "node long, links long, root long")
