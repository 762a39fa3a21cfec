"""A manifest of a data set as a Merkle tree whose parents keep SHA-256 midstates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

FANOUT = 16
ROOT = ""
PIECE = 2048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fraction(prime: int, root: int) -> int:
    """The first 32 bits after the point of a prime's square or cube root."""
    if root == 2:
        return isqrt(prime << 64) & 0xFFFFFFFF
    low, high = 0, 1 << 40
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**3 <= prime << 96 else (low, middle)
    return low & 0xFFFFFFFF


_PRIMES = [n for n in range(2, 312) if all(n % k for k in range(2, isqrt(n) + 1))]
_ROUNDS = [np.uint32(_fraction(p, 3)) for p in _PRIMES]
START = np.array([_fraction(p, 2) for p in _PRIMES[:8]], np.uint32)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def advance(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256 states (8 x n words) after one more block each (16 x n words)."""
    w = list(blocks)
    for k in range(16, 64):
        a, b = w[k - 15], w[k - 2]
        low = _turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))
        w.append(w[k - 16] + low + w[k - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = states
    for k in range(64):
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (_ROUNDS[k] + w[k])
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h])


def block_of(digests: np.ndarray) -> np.ndarray:
    """The block that the hex text of each digest (n x 32 bytes) fills exactly."""
    text = np.stack([_DIGITS[digests >> 4], _DIGITS[digests & 15]], 2).reshape(len(digests), 64)
    return np.ascontiguousarray(text).view(">u4").astype(np.uint32).T


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) of inputs that were whole blocks, as many as ``blocks`` says."""
    last = np.zeros((16, states.shape[1]), np.uint32)
    last[0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    last[14], last[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return _bytes(advance(states, last))


def _bytes(states: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(states.T).astype(">u4").view(np.uint8)


def _states(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).T


def _fixed(column: pa.Array, width: int = 32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row from the fields of its columns."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows``, written, with ``pos``, the place in its group by ``order``, and ``left``, the group's size.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over
    partitions; what is added up per group is one row of each partition that holds it.
    """
    dealt = written(
        rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).select(
            "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
        ),
        f"{name}-dealt",
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    offsets = written(
        parts.select(
            group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy(group)).alias("left"),
        ),
        f"{name}-offsets",
    )
    placed = dealt.join(offsets, [group, "_part"])
    return written(
        placed.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "left"), name
    )


def parents_of(nodes: DataFrame) -> DataFrame:
    """(tree, pos, left, digest, states, children) over runs of 16 nodes (tree, pos, left, digest).

    ``states`` holds the hash state before each child's slot, 32 bytes each: a child's
    hex text fills one block, so a state is eight words and nothing is pending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = pa.compute.list_value_length(batch.column(3)).to_numpy()
            children = _fixed(batch.column(3).flatten())
            start = np.cumsum(count) - count
            state = np.repeat(START[:, None], len(count), 1)
            states = np.zeros((len(children), 32), np.uint8)
            for slot in range(int(count.max(initial=0))):
                has = count > slot
                at = start[has] + slot
                states[at] = _bytes(state[:, has])
                state[:, has] = advance(state[:, has], block_of(children[at]))
            ends = np.concatenate([[0], np.cumsum(count) * 32]).astype(np.int32)
            kept = [
                pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])
                for x in (states, children)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _binary(finish(state, count)), *kept],
                ["tree", "pos", "left", "digest", "states", "children"],
            )

    runs = nodes.groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(
        F.ceil(F.first("left") / FANOUT).alias("left"),
        F.sort_array(F.collect_list(F.struct(F.col("pos").alias("slot"), "digest"))).alias("run"),
    )
    return runs.select("tree", "pos", "left", F.col("run.digest").alias("run")).mapInArrow(
        run, "tree string, pos long, left long, digest binary, states binary, children binary"
    )


def grown(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The parents of each level, lowest first, and (tree, digest) of each tree's top.

    ``nodes`` are written (tree, pos, left, digest). A level has a sixteenth of the
    nodes below, so there are as many levels as the largest tree's count has hex digits.
    """
    levels, tops = [], [nodes.where("left = 1")]
    nodes = nodes.where("left > 1")
    while not nodes.isEmpty():
        levels.append(written(parents_of(nodes), f"{name}-level{len(levels)}"))
        tops.append(levels[-1].where("left = 1"))
        nodes = levels[-1].where("left > 1")
    return levels, reduce(DataFrame.unionByName, [t.select("tree", "digest") for t in tops])


@dataclass(frozen=True)
class Manifest:
    """Written tables: ``leaves`` (tree, pos, left and the given columns), the parents of
    each level below the subroots, ``subroots`` (tree = root tree, source, pos, left, digest),
    the parents above them, and ``root``, one row (none for an empty data set)."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    upper: list[DataFrame]
    root: DataFrame


def source_key(source: Column) -> Column:
    """A text that orders sources null first, then by their bytes, and is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def build(leaves: DataFrame) -> Manifest:
    """The trees over ``leaves``: (tree, id, digest, file, row, ...), ``tree`` by ``source_key``.

    Leaves of a tree ascend by id, null first; equal ids by digest, then by place in the files.
    """
    # Dealing by ranges reads its input twice; the texts are hashed once.
    placed = numbered(written(leaves, "hashed"), "tree", ["id", "digest", "file", "row"], "leaves")
    levels, tops = grown(placed.select("tree", "pos", "left", "digest"), "sources")
    tops = tops.select(F.lit(ROOT).alias("tree"), F.col("tree").alias("source"), "digest")
    subroots = numbered(tops, "tree", ["source"], "subroots")
    upper, root = grown(subroots.select("tree", "pos", "left", "digest"), "root")
    return Manifest(placed, levels, subroots, upper, root)


def fold_step(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """``rows`` (key, tree, pos, digest, proof, blocks) one level up; those of finished trees stay.

    The parent's state before the row's slot goes on with the row's own digest and the
    siblings to its right alone. ``proof`` is the state of the hash over all siblings
    met so far, ``blocks`` their number.
    """

    def climb(states, children, slot, digest, proof):
        count = np.array([len(c) // 32 for c in children])
        start = np.cumsum(count) - count
        kids = np.frombuffer(b"".join(children), np.uint8).reshape(-1, 32)
        before = np.frombuffer(b"".join(s[32 * k : 32 * k + 32] for s, k in zip(states, slot)), np.uint8)
        fold = advance(_states(before.reshape(-1, 32)), block_of(digest))
        kid_blocks = block_of(kids)
        for k in range(int(count.max(initial=0))):
            right = np.flatnonzero((count > k) & (slot < k))
            other = np.flatnonzero((count > k) & (slot != k))
            both = np.concatenate([fold[:, right], proof[:, other]], 1)
            both = advance(both, kid_blocks[:, np.concatenate([start[right], start[other]]) + k])
            fold[:, right], proof[:, other] = both[:, : len(right)], both[:, len(right) :]
        return finish(fold, count), proof, count - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "tree", "pos", "digest", "proof", "blocks"]
        for batch in batches:
            for part in (batch.slice(at, PIECE) for at in range(0, batch.num_rows, PIECE)):
                digest, proof = _fixed(part.column(3)).copy(), _states(_fixed(part.column(4))).copy()
                pos, blocks = part.column(2).to_numpy().copy(), part.column(5).to_numpy().copy()
                on = np.flatnonzero(part.column(6).is_valid().to_numpy(zero_copy_only=False))
                if len(on):
                    held = part.take(pa.array(on))
                    digest[on], proof[:, on], more = climb(
                        held.column(6).to_pylist(), held.column(7).to_pylist(), pos[on] % FANOUT, digest[on], proof[:, on]
                    )
                    pos[on], blocks[on] = pos[on] // FANOUT, blocks[on] + more
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(pos), _binary(digest), _binary(_bytes(proof)), pa.array(blocks)], names
                )

    above = parents.select("tree", F.col("pos").alias("up"), "states", "children")
    met = rows.withColumn("up", F.floor(F.col("pos") / FANOUT)).join(above, ["tree", "up"], "left")
    return met.select("key", "tree", "pos", "digest", "proof", "blocks", "states", "children").mapInArrow(run, rows.schema)


def fold(manifest: Manifest, replacements: DataFrame) -> DataFrame:
    """(key, folded_root, proof) of ``replacements`` (key, tree, pos, digest): the root with that digest as leaf.

    ``proof`` is the digest over the hex texts of all siblings, level by level from the
    leaf's run to the root's.
    """
    rows = replacements.select(
        "key", "tree", "pos", "digest", F.lit(bytearray(_bytes(START[:, None]).tobytes())).alias("proof"),
        F.lit(0).cast("long").alias("blocks"),
    )
    # Each step is written, so a task runs one Python worker however many levels there are.
    for parents in manifest.levels:
        rows = written(fold_step(rows, parents), "folded")
    places = manifest.subroots.select(F.col("tree").alias("_root"), F.col("source").alias("tree"), F.col("pos").alias("_pos"))
    rows = rows.drop("pos").join(places, "tree").select(
        "key", F.col("_root").alias("tree"), F.col("_pos").alias("pos"), "digest", "proof", "blocks"
    )
    for parents in manifest.upper:
        rows = written(fold_step(rows, parents), "folded")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof = finish(_states(_fixed(batch.column(2))), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(proof)], ["key", "folded_root", "proof"])

    return rows.select("key", "digest", "proof", "blocks").mapInArrow(end, "key long, folded_root binary, proof binary")


def verify(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tamper_every: int = 5,
) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of every row of ``docs``, digests as binary.

    ``docs`` reads files. A leaf is the digest of ``columns``; the rows of a source are
    one tree, the sources' tops another. Where ``tamper_every`` divides the CRC-32 of
    the id, the folded leaf is that of the row with its text in lower case (A-Z); such
    a row is verified only if that changes nothing. Null and empty texts differ; rows
    without an id come first in their source and are never tampered with; rows of one
    source and id are ordered by their leaves, equal ones by their place in the files; rows
    without a source are a tree of their own, the first; other columns play no part; an
    empty table gives no rows.
    """
    changed = [F.translate(F.col(c), _UPPER, _LOWER) if c == text_col else F.col(c) for c in columns]
    tampered = F.crc32(docs[id_col].cast("string")) % tamper_every == 0
    leaves = docs.select(
        source_key(docs[source_col]).alias("tree"), docs[id_col].alias("id"),
        leaf(*[docs[c] for c in columns]).alias("digest"), F.when(tampered, leaf(*changed)).alias("changed"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    manifest = build(leaves)
    # A row's key is its number among the written leaves of its tree's range.
    keyed = written(manifest.leaves.select("*", F.monotonically_increasing_id().alias("key")), "keyed-leaves")
    folded = fold(manifest, keyed.select("key", "tree", "pos", F.coalesce("changed", "digest").alias("digest")))
    tops = manifest.subroots.select(F.col("source").alias("tree"), F.col("digest").alias("subroot"))
    root = manifest.root.select(F.col("digest").alias("root")).first()
    whole = F.lit(bytearray(root["root"]) if root else None).cast("binary")
    joined = keyed.select("key", "id", "tree", F.col("digest").alias("leaf")).join(tops, "tree").join(folded, "key")
    return joined.select(
        "id", "leaf", "subroot", whole.alias("root"), "proof", "folded_root", (F.col("folded_root") == whole).alias("verified")
    )
