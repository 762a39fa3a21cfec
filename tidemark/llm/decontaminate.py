"""Benchmark decontamination: containment search for short items inside long documents."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 5
CONTAINMENT = 0.8
SKETCH = 32
# A block of items holds at most this many distinct shingles (and one item at least),
# which bounds what a task is sent.
BLOCK_SHINGLES = 200_000
CHUNK = 1 << 20

# Words are runs of ASCII letters, digits and underscores and of all other alphabets' bytes.
_WORD = re.compile(rb"[0-9a-z_\x80-\xff]+")
_IN_WORD = np.array([bool(_WORD.match(bytes([c]))) for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LANES = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(1, WIDTH + 1)]


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def shingles(text: bytes | None) -> set[tuple[bytes, ...]]:
    """The distinct shingles of five words; of a shorter text none."""
    found = words(text or b"")
    return set(zip(*(found[k:] for k in range(WIDTH))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every shingle occurrence of some texts, in one go.

    A word's hash is its polynomial, taken from the running sum over the whole buffer.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < WIDTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power = np.full(len(data), _BASE)
    power[0] = 1
    back = np.full(len(data), _INVERSE)
    back[0] = 1
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power))
    before = np.concatenate([[np.uint64(0)], sums])
    hashes = _mixed((before[ends] - before[starts]) * np.multiply.accumulate(back)[starts])
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    count = len(hashes) - WIDTH + 1
    joined = np.zeros(count, np.uint64)
    for k in range(WIDTH):
        joined += hashes[k : k + count] * _LANES[k]
    within = owner[:count] == owner[WIDTH - 1 :]
    return _mixed(joined)[within], owner[:count][within]


def hits_needed(size: int, sketch: int, containment: float = CONTAINMENT, risk: float = 1e-6) -> int:
    """The most hits an item at the threshold reaches but for a chance below ``risk``.

    A document that holds the least share allowed of the item's ``size`` shingles
    holds a hypergeometric number of the ``sketch`` lowest hashes; the whole item as
    a sketch makes it exact.
    """
    have = math.ceil(containment * size - 1e-9)
    total, below = math.comb(size, sketch), 0
    for hits in range(sketch + 1):
        below += math.comb(have, hits) * math.comb(size - have, sketch - hits)
        if below > risk * total:
            return max(1, hits)
    return max(1, sketch)


class Block:
    """Some items, by size class, with their MinHash sketches and exact shingles."""

    def __init__(self, items: list[tuple[int, set[tuple[bytes, ...]]]], containment: float = CONTAINMENT):
        self.containment = containment
        self.ids = [item for item, _ in items]
        self.exact = [found for _, found in items]
        self.classes = []
        by_class = defaultdict(list)
        for at, found in enumerate(self.exact):
            by_class[(len(found) - 1).bit_length()].append(at)
        for _, members in sorted(by_class.items()):
            owners, needed = defaultdict(list), {}
            for at in members:
                texts = [b" ".join(s) for s in self.exact[at]]
                sketch = sorted(set(shingle_hashes(texts)[0].tolist()))[:SKETCH]
                needed[at] = hits_needed(len(texts), len(sketch), containment)
                for value in sketch:
                    owners[value].append(at)
            values = np.array(sorted(owners), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
            least = min(math.ceil(containment * len(self.exact[at]) - 1e-9) for at in members)
            self.classes.append((least, values, seen, [owners[v] for v in values.tolist()], needed))

    def candidates(self, texts: list[bytes]) -> dict[int, list[int]]:
        """Items by text that reach the hits they need, each size class by itself."""
        hashes, owner = shingle_hashes(texts)
        sizes = np.bincount(owner, minlength=len(texts))
        low = (hashes & np.uint64(0xFFFFF)).astype(np.int64)
        found = defaultdict(list)
        for least, values, seen, owners, needed in self.classes:
            at = np.flatnonzero(seen[low])
            at = at[sizes[owner[at]] >= least]
            place = np.minimum(np.searchsorted(values, hashes[at]), len(values) - 1)
            right = values[place] == hashes[at]
            hits: dict[tuple[int, int], int] = defaultdict(int)
            pairs = np.unique(np.column_stack([owner[at][right], place[right]]), axis=0)
            for text, value in pairs.tolist():
                for item in owners[value]:
                    hits[text, item] += 1
            for (text, item), n in hits.items():
                if n >= needed[item]:
                    found[text].append(item)
        return found

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item id, item shingles, shared shingles), compared shingle by shingle."""
        for text, items in self.candidates(texts).items():
            whole = shingles(texts[text])
            for item in items:
                shared = len(self.exact[item] & whole)
                if shared >= self.containment * len(self.exact[item]) - 1e-9:
                    yield text, self.ids[item], len(self.exact[item]), shared


def blocks(items: DataFrame, id_col: str, text_col: str, bound: int, containment: float) -> Iterator[Block]:
    """The items in blocks of bounded size; texts without a shingle fit nothing."""
    held, size = [], 0
    narrow = items.select(items[id_col].cast("long"), items[text_col].cast("binary"))
    for item, text in narrow.where(items[id_col].isNotNull()).toLocalIterator():
        found = shingles(bytes(text or b""))
        if not found:
            continue
        if held and size + len(found) > bound:
            yield Block(held, containment)
            held, size = [], 0
        held.append((item, found))
        size += len(found)
    if held:
        yield Block(held, containment)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = CONTAINMENT,
    bound: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment) of items found in documents.

    Items are the stated, small query set: they are partitioned by size and sketched
    by their lowest hashes, and every shingle of every document is looked up in the
    sketches of each size class that the document is large enough for. Pairs with
    enough hits are compared shingle by shingle. The documents are not shuffled. Items
    beyond ``bound`` shingles go in further blocks, one scan each.

    Null texts are empty; items of fewer than five words are not searched; rows
    without an id are skipped; repeated rows are reported as often as they occur;
    empty tables give no rows.
    """
    schema = "doc_id long, item_id long, item_shingles long, shared_shingles long"
    narrow = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text")
    ).where("doc_id is not null")
    found = None
    for block in blocks(items, item_id_col, item_text_col, bound, containment):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            def out(ids, texts):
                rows = [(ids[k], *rest) for k, *rest in shared.value.matches(texts)]
                columns = list(zip(*rows)) or [[]] * 4
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns],
                    ["doc_id", "item_id", "item_shingles", "shared_shingles"],
                )

            for batch in batches:
                ids, texts, size = [], [], 0
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids.append(row)
                    texts.append(text.as_py() or b"")
                    size += len(texts[-1])
                    if size > CHUNK:
                        yield out(ids, texts)
                        ids, texts, size = [], [], 0
                if ids:
                    yield out(ids, texts)

        part = narrow.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item; all columns stay as they are, rows without an id stay."""
    from tidemark.llm.shared import written

    gone = written(contained_items(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
