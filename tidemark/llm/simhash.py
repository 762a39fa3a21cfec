"""Near-duplicates by SimHash fingerprints, found through the anchors of a covering code."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import written

# Segments of the 64 bits: (first bit, bits, differing bits looked for, parity rows).
# If two fingerprints differed by more than 1, 1 and 0 bits in the three segments,
# they would differ by 2 + 2 + 1 bits at least, so each pair within four bits meets
# the threshold of some segment.
SEGMENTS = ((0, 22, 1, 4), (22, 22, 1, 4), (44, 20, 0, 0))
THRESHOLD = 4
BLOCK = 4096


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, as an unsigned 64-bit number.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased; each
    occurrence of a shingle counts. A bit is set if it is set in more than half of
    the shingles' XXH64. Fewer words than ``width`` make one shingle; none give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    take = min(width, len(words))
    count = len(words) - take + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[:count].tolist(), ends[take - 1 :].tolist())),
        np.uint64,
        count,
    )
    total = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        # Runs of 255 rows cannot overflow a byte and add up fast.
        whole = len(bits) // 255 * 255
        if whole:
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every document; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(value.as_py()) for value in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    narrow = docs.select(
        docs[id_col].cast("long").alias("id"), docs[text_col].cast("binary").alias("text")
    )
    return narrow.mapInArrow(run, "id long, fp long")


def anchor_table(bits: int, threshold: int, parity: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The covering code of a segment: (error patterns, leaders, columns) by syndrome.

    The code has ``parity`` check rows whose columns run through all non-zero
    syndromes again and again, so every word is within one bit of a code word
    (covering radius 1; with no check rows every word is a code word). The patterns
    of a syndrome lead from a word with it to all code words within radius plus
    threshold; the leader is the lightest of them and leads to the home anchor.
    """
    size = 1 << parity
    columns = np.array([i % (size - 1) + 1 if parity else 0 for i in range(bits)], np.int64)
    reach = threshold + (1 if parity else 0)
    patterns: dict[int, list[int]] = defaultdict(list)
    for weight in range(reach + 1):
        for flips in combinations(range(bits), weight):
            syndrome = int(np.bitwise_xor.reduce(columns[list(flips)])) if flips else 0
            patterns[syndrome].append(sum(1 << i for i in flips))
    return (
        [np.array(patterns[s], np.int64) for s in range(size)],
        np.array([patterns[s][0] for s in range(size)], np.int64),
        columns,
    )


def anchors(prints: DataFrame, segments=SEGMENTS) -> DataFrame:
    """Replicate each (rep, fp) to every anchor within covering radius plus threshold.

    Returns (anchor, home, rep, fp); ``home`` marks the anchor within the covering
    radius. Of two fingerprints within the threshold of a segment, the home anchor
    of one is an anchor of the other.
    """
    tables = [anchor_table(bits, threshold, parity) for _, bits, threshold, parity in segments]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False)
            for number, ((first, bits, _, _), (patterns, leaders, columns)) in enumerate(zip(segments, tables)):
                part = (prints.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)
                syndrome = np.zeros(len(part), np.int64)
                for bit, column in enumerate(columns.tolist()):
                    syndrome ^= (part >> bit & 1) * column
                for value in np.unique(syndrome):
                    rows = np.flatnonzero(syndrome == value)
                    errors = patterns[value]
                    found = (part[rows, None] ^ errors[None, :]).ravel() | number << 58
                    home = np.broadcast_to(errors == leaders[value], (len(rows), len(errors))).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found),
                            pa.array(home),
                            pa.array(np.repeat(reps[rows], len(errors))),
                            pa.array(np.repeat(prints[rows], len(errors))),
                        ],
                        ["anchor", "home", "rep", "fp"],
                    )

    return prints.select("rep", "fp").mapInArrow(run, "anchor long, home boolean, rep long, fp long")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reached) of the nodes of some links, without those that are their own."""
    nodes, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(keys, role, reps, prints, threshold: int, chunk: int = 2_000_000):
    """Links between the home rows and all rows of each run of equal keys, as a forest."""
    group = np.cumsum(np.concatenate([[0], np.any(keys[1:] != keys[:-1], axis=1)]))
    homes, others = np.flatnonzero(role >= 1), np.flatnonzero(role != 1)
    first = np.searchsorted(group[others], group[homes], "left")
    count = np.searchsorted(group[others], group[homes], "right") - first
    total, links = np.cumsum(count), []
    at = 0
    while at < len(homes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + chunk, "right")))
        n = count[at:to]
        left = np.repeat(homes[at:to], n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        right = others[np.repeat(first[at:to], n) + inside]
        near = np.bitwise_count(prints[left] ^ prints[right]) <= threshold
        u, v = reps[left[near]], reps[right[near]]
        if (u != v).any():
            links.append(forest(u, v))
        at = to
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(*(np.concatenate(x) for x in zip(*links)))


def links(prints: DataFrame, segments=SEGMENTS, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between the reps of (rep, fp) rows with one row per fingerprint.

    The edges connect exactly what the pairs within ``threshold`` bits connect: each
    comparison returns a spanning forest of the pairs it finds, so that a dense group
    gives no more edges than it has members. An anchor with more than ``block`` rows
    is split: its home rows and all its rows fall into blocks by hash, and each pair
    of blocks is compared by a task of its own.
    """
    rows = anchors(prints, segments)
    crowded = written(
        rows.groupBy("anchor").count().where(F.col("count") > block)
        .select("anchor", F.ceil(F.col("count") / block).cast("int").alias("blocks")),
        "crowded-anchors",
    )
    dealt = rows.join(crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    numbers = F.sequence(F.lit(0), F.col("blocks") - 1)
    alone = F.array(
        F.struct(
            F.lit(0).alias("i"), F.lit(0).alias("j"),
            F.when(F.col("home"), 2).otherwise(0).alias("role"),
        )
    )
    as_any = F.transform(numbers, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(0).alias("role")))
    as_home = F.transform(numbers, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(1).alias("role")))
    places = F.when(F.col("blocks") == 1, alone).otherwise(
        F.when(F.col("home"), F.concat(as_any, as_home)).otherwise(as_any)
    )
    dealt = dealt.select("anchor", "rep", "fp", F.explode(places).alias("at")).select(
        "anchor", "at.i", "at.j", "at.role", "rep", "fp"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out(table: np.ndarray) -> pa.RecordBatch:
            u, v = _compare(table[:, :3], table[:, 3], table[:, 4], table[:, 5].copy().view(np.uint64), threshold)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            kept.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            table = np.concatenate(kept) if len(kept) > 1 else kept[0]
            # The last run of equal keys may go on in the next batch.
            cut = len(table) - 1
            same = np.flatnonzero(np.any(table[:, :3] != table[-1, :3], axis=1))
            cut = same[-1] + 1 if len(same) else 0
            kept = [table[cut:]]
            if cut:
                yield out(table[:cut])
        if kept and len(kept[0]):
            yield out(kept[0])

    return (
        dealt.repartition("anchor", "i", "j")
        .sortWithinPartitions("anchor", "i", "j")
        .mapInArrow(run, "u long, v long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """(id, fp, component_id) of every document; component_id is the smallest id reachable.

    Null and empty texts have fingerprint 0 and link like others. Equal fingerprints
    are one node; rows of one id are each returned. Rows without an id take part with
    their fingerprint only where another row has it, and get its component, or null.
    Other columns are not looked at. An empty table gives no rows.
    """
    if threshold > THRESHOLD:
        raise ValueError("the segments cover up to four differing bits")
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    found = connected_components(links(nodes.where("rep is not null"), threshold=threshold))
    labels = nodes.join(found, nodes["rep"] == found["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(labels, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose group has a smaller id; all columns stay as they are."""
    found = near_duplicates(docs, id_col, text_col).where("id <> component_id")
    gone = written(found.select(F.col("id").alias(id_col)).distinct(), "near-copies")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
