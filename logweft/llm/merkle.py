"""Merkle manifest of a dataset whose parents keep the state of their hash before each child.

A digest enters its parent as 64 hexadecimal characters, which is one block of SHA-256. So the state of a
parent's hash before a child is the state after as many blocks, eight 32-bit words, and can be stored. A
replaced child is folded into the parent by taking up that state and adding the replacement and the
children to its right only. ``hashlib`` gives no states away, so blocks are added here, by numpy over
many nodes at once; texts, and proofs that are only read once, are hashed by library functions.

Runs of ``FAN`` nodes have one parent. A task builds a subtree of ``DEEP`` levels (4,096 leaves at most)
and folds its leaves up to its top; the tops are the leaves of the next table, an eight to the fourth of the size.
The trees of all keys are built in the same jobs, and one key's leaves are spread over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import number_rows
from ..session import materialize

FAN, DEEP = 8, 4
_BLOCK = FAN**DEEP


def _roots(count: int, root: int) -> np.ndarray:
    """The first 32 bits of the fractions of the square (2) or cube (3) roots of the first primes."""
    primes = [p for p in range(2, 320) if all(p % q for q in range(2, int(p**0.5) + 1))][:count]
    out = []
    for p in primes:
        wanted, low, high = p << (32 * root), 0, p << 32
        while low < high:  # the whole root of p * 2^(32 root)
            mid = (low + high + 1) // 2
            low, high = (mid, high) if mid**root <= wanted else (low, mid - 1)
        out.append(low & 0xFFFFFFFF)
    return np.array(out, np.uint32)


_INITIAL, _ROUND = _roots(8, 2), _roots(64, 3)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def fresh(n: int) -> np.ndarray:
    """States of ``n`` empty hashes: 8 words each, one column a hash."""
    return np.repeat(_INITIAL[:, None], n, axis=1)


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 states (8, n) after a further block (16, n) of 64 bytes each."""
    w = list(block)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        small = _turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))
        large = _turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))
        w.append(w[i - 16] + small + w[i - 7] + large)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUND[i] + w[i]
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digest blocks (16, n) of hashes that took so many whole blocks: padding, then hexadecimal text."""
    pad = np.zeros((16, state.shape[1]), np.uint32)
    pad[0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    pad[14], pad[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    words = absorb(state, pad)
    raw = np.ascontiguousarray(words.T).astype(">u4").view(np.uint8)  # (n, 32)
    nibbles = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), 64)
    text = np.frombuffer(b"0123456789abcdef", np.uint8)[nibbles]
    return _blocks(text)


def _blocks(text: np.ndarray) -> np.ndarray:
    """(n, 64) characters as blocks (16, n)."""
    return np.ascontiguousarray(np.ascontiguousarray(text).view(">u4").astype(np.uint32).T)


def _text(blocks: np.ndarray) -> np.ndarray:
    """Blocks (16, n) as (n, 64) characters."""
    return np.ascontiguousarray(np.ascontiguousarray(blocks.T).astype(">u4")).view(np.uint8).reshape(-1, 64)


def parents(children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest blocks of the parents, states before each child) for a level of nodes (16, n) in order."""
    n = children.shape[1]
    m = -(-n // FAN)
    state, before = fresh(m), np.empty((8, n), np.uint32)
    for slot in range(min(FAN, n)):
        at = np.arange(slot, n, FAN)
        before[:, at] = state[:, : len(at)]
        state[:, : len(at)] = absorb(state[:, : len(at)], children[:, at])
    return finish(state, np.minimum(FAN, n - FAN * np.arange(m))), before


def fold(own: np.ndarray, index: np.ndarray, level: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Digests of the parents if child ``index`` were ``own`` (16, n): from the state before it and the children to its right."""
    n = level.shape[1]
    state = absorb(before[:, index], own)
    last = np.minimum(index - index % FAN + FAN, n)  # behind the run
    for step in range(1, FAN):
        at = np.flatnonzero(index + step < last)
        if not len(at):
            break
        state[:, at] = absorb(state[:, at], level[:, index[at] + step])
    return finish(state, last - (index - index % FAN))


def _depth(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _build(group: pa.Table) -> pa.Table:
    """One row for a block of a tree's leaves: the top, and by level the digests and the states before each child."""
    group = group.take(pa.array(np.argsort(group["at"].to_numpy())))
    n = group["n"][0].as_py()
    level = _blocks(np.frombuffer("".join(group["digest"].to_pylist()).encode(), np.uint8).reshape(-1, 64))
    digests, states = [], []
    for _ in range(min(DEEP, _depth(n))):
        above, before = parents(level)
        digests.append(_text(level).tobytes())
        states.append(before.tobytes())
        level = above
    row = {"tree": group["tree"][0], "block": group["block"][0], "n": n, "top": _text(level)[0].tobytes().decode()}
    return pa.Table.from_pylist([row | {"digests": digests, "states": states}], _BLOCKS)


_BLOCKS = pa.schema([
    ("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("top", pa.string()),
    ("digests", pa.list_(pa.binary())), ("states", pa.list_(pa.binary())),
])
_BLOCKS_DDL = "tree long, block long, n long, top string, digests array<binary>, states array<binary>"
_STEP_DDL = "array<struct<slot:int,before:binary,siblings:binary>>"


def _levels(digests: list[bytes], states: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (np.frombuffer(d, np.uint8).reshape(-1, 64), np.frombuffer(s, np.uint32).reshape(8, -1))
        for d, s in zip(digests, states)
    ]


def _siblings(text: np.ndarray, i: int) -> bytes:
    first = i - i % FAN
    return text[first:i].tobytes() + text[i + 1 : first + FAN].tobytes()


def _paths(batches):
    """For each child of stored blocks what folding it up to the block's top takes: slot, state and siblings by level."""
    for batch in batches:
        for row in batch.to_pylist():
            levels, out = _levels(row["digests"], row["states"]), []
            for child in range(len(levels[0][0]) if levels else 1):
                i, path = child, []
                for text, before in levels:
                    path.append({"slot": i % FAN, "before": before[:, i].tobytes(), "siblings": _siblings(text, i)})
                    i //= FAN
                out.append({"tree": row["tree"], "at": row["block"] * _BLOCK + child, "up": row["block"], "path": path})
            yield pa.RecordBatch.from_pylist(out, _PATHS)


_PATHS = pa.schema([
    ("tree", pa.int64()), ("at", pa.int64()), ("up", pa.int64()),
    ("path", pa.list_(pa.struct([("slot", pa.int32()), ("before", pa.binary()), ("siblings", pa.binary())]))),
])


def build(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, tops) of the trees over ``nodes`` (tree, at, digest, n): places from 0, n nodes in the tree.

    ``blocks`` is the stored table of all subtrees over the nodes. ``tops``: (tree, block, top, path) with the tree's
    top and what folding the top of a block up to it takes.
    """
    block = F.floor(F.col("at") / _BLOCK).alias("block")
    dealt = nodes.select("tree", block, "at", "digest", "n")
    blocks = materialize(dealt.groupBy("tree", "block").applyInArrow(_build, _BLOCKS_DDL), "merkle-blocks")
    whole = F.col("n") <= _BLOCK
    tops = blocks.filter(whole).select("tree", "block", "top", F.array().cast(_STEP_DDL).alias("path"))
    rest = blocks.filter(~whole)
    if not rest.isEmpty():
        upper = rest.select("tree", F.col("block").alias("at"), F.col("top").alias("digest"), F.ceil(F.col("n") / _BLOCK).alias("n"))
        upper_blocks, upper_tops = build(upper)
        path = upper_blocks.select("tree", "block", "digests", "states").mapInArrow(_paths, f"tree long, at long, up long, path {_STEP_DDL}")
        above = upper_tops.select("tree", F.col("block").alias("up"), "top", F.col("path").alias("__on"))
        joined = path.join(above, ["tree", "up"]).select("tree", F.col("at").alias("block"), "top", F.concat("path", "__on").alias("path"))
        tops = materialize(tops.unionByName(joined), "merkle-tops")
    return blocks, tops


def _fold_block(leaves: pa.Table, base: pa.Table) -> pa.Table:
    """Folds the replacements of a block's leaves up to the root, and hashes the siblings on the way."""
    base = base.slice(0, 1).to_pylist()[0]
    index = leaves["at"].to_numpy() % _BLOCK
    own = _blocks(np.frombuffer("".join(leaves["replacement"].to_pylist()).encode(), np.uint8).reshape(-1, 64))
    proofs = [hashlib.sha256() for _ in range(len(index))]
    for text, before in _levels(base["digests"], base["states"]):
        own = fold(own, index, _blocks(text), before)
        for i, proof in zip(index.tolist(), proofs):
            proof.update(_siblings(text, i))
        index = index // FAN
    for step in base["path"]:
        others = _blocks(np.frombuffer(step["siblings"], np.uint8).reshape(-1, 64))
        state = np.repeat(np.frombuffer(step["before"], np.uint32)[:, None], own.shape[1], axis=1)
        state = absorb(state, own)
        for k in range(step["slot"], others.shape[1]):
            state = absorb(state, others[:, k : k + 1])
        own = finish(state, np.full(own.shape[1], others.shape[1] + 1))
        for proof in proofs:
            proof.update(step["siblings"])
    folded = [x.tobytes().decode() for x in _text(own)]
    n = len(folded)
    return pa.table({
        "row": leaves["row"], "leaf": leaves["leaf"], "subroot": pa.array([base["subroot"]] * n, pa.string()), "root": pa.array([base["root"]] * n, pa.string()),
        "proof_sha256": pa.array([p.hexdigest() for p in proofs], pa.string()), "folded_root": pa.array(folded, pa.string()),
    }).append_column("id", leaves["id"])


def encoded(columns: list[Column]) -> Column:
    """What a leaf hashes: each value `-` if null, else its length in bytes, a colon and its text."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text])


#: A table of keys up to this many rows is sent to every task; a longer one is joined by shuffle.
BROADCAST_KEYS = 200_000


def manifest(
    df: DataFrame, fields: list[str], tampered: dict[str, Column], where: Column, id_column: str = "doc_id", key: str = "lang"
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``df``.

    A leaf hashes ``fields``. Leaves of one ``key`` (null is a key of its own) are ordered by id (null first), ties by
    leaf; equal rows are leaves of their own, and as they are equal it does not matter which comes first. The trees' tops, by
    key in byte order, null first, are the leaves of the last tree. A tree of one leaf is that leaf; no rows give none.
    ``folded_root`` folds the leaf in which ``tampered`` takes the place of the fields so named, in rows
    ``where`` that is true (null: not), else the leaf itself, by the stored states.
    """
    column = lambda c: F.col(f"`{c}`")
    leaf = F.sha2(encoded([column(c) for c in fields]), 256)
    other = F.sha2(encoded([tampered.get(c, column(c)) for c in fields]), 256)
    leaves = df.select(
        column(id_column).alias("id"), column(key).alias("key"), leaf.alias("leaf"), F.when(where, other).otherwise(leaf).alias("replacement"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialize(leaves, "merkle-leaves")
    placed = materialize(number_rows(leaves, ["key", "id", "leaf", "row"], "place"), "merkle-places")
    keys = placed.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    keys = materialize(number_rows(keys, ["key"], "tree"), "merkle-keys")
    n_keys = keys.count()
    small = F.broadcast if n_keys <= BROADCAST_KEYS else lambda x: x
    dealt = placed.join(small(keys.withColumnRenamed("key", "of")), F.col("key").eqNullSafe(F.col("of"))).select(
        "tree", (F.col("place") - F.col("first")).alias("at"), "n", "id", "row", "leaf", "replacement"
    )
    blocks, tops = build(dealt.select("tree", "at", F.col("leaf").alias("digest"), "n"))
    subroots = tops.filter("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("top").alias("digest"))
    last_blocks, last_tops = build(subroots.withColumn("n", F.lit(n_keys).cast("long")))
    last = last_blocks.select("tree", "block", "digests", "states").mapInArrow(_paths, f"tree long, at long, up long, path {_STEP_DDL}")
    last = last.join(last_tops.select(F.col("block").alias("up"), F.col("top").alias("root"), F.col("path").alias("__on")), "up")
    last = last.select(F.col("at").alias("tree"), "root", F.concat("path", "__on").alias("__last"))
    way = tops.join(last, "tree").select("tree", "block", F.col("top").alias("subroot"), "root", F.concat("path", "__last").alias("path"))
    base = blocks.select("tree", "block", "digests", "states").join(way, ["tree", "block"])
    folds = dealt.withColumn("block", F.floor(F.col("at") / _BLOCK)).select("tree", "block", "at", "id", "row", "leaf", "replacement")
    id_type = placed.schema["id"].dataType.simpleString()
    out = folds.groupBy("tree", "block").cogroup(base.groupBy("tree", "block")).applyInArrow(
        _fold_block, f"row long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, id {id_type}"
    )
    return out.select(
        F.col("id").alias(id_column), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
