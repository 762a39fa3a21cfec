"""Phrase collocations: n-gram counts by multikey quicksort of suffix pointers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
SALTS = 256
UNKNOWN = "und"
CHUNK_BYTES = 1 << 20
ROUTE_ROWS = 1 << 19
OUT_ROWS = 1 << 16
FILTER_BITS = 26
_TABLE = bytes(
    0x20 if b in b"\t " else 0x0A if b in b".,;:!?\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def tokens(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word ids, the distinct words, piece of each word) of a text in which pieces end at stops and lines."""
    data = np.frombuffer(text.translate(_TABLE), np.uint8)
    stop = data == 0x0A
    gap = stop | (data == 0x20)
    inside = ~gap
    before = np.concatenate([[True], gap[:-1]])
    starts = np.flatnonzero(inside & before)
    packed = data[inside]
    ends = np.concatenate([np.cumsum(inside)[starts] - 1, [len(packed)]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.cumsum(stop)[starts]


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of the rows of a batch, texts of one language joined up to about a megabyte."""
    pending: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        raw = text.as_py() or b""
        pending.setdefault(lang, []).append(raw)
        sizes[lang] = sizes.get(lang, 0) + len(raw) + 1
        if sizes[lang] >= CHUNK_BYTES:
            yield lang, b"\n".join(pending.pop(lang))
            del sizes[lang]
    for lang, texts in pending.items():
        yield lang, b"\n".join(texts)


def _phrases(words: pa.Array, parts: list[np.ndarray]) -> pa.Array:
    """The words with the ids of ``parts`` joined by blanks, -1 for none."""
    columns = [pc.take(words, pa.array(p, mask=p < 0)) for p in parts]
    return pc.binary_join_element_wise(*columns, " ", null_handling="skip")


def _rows(lang: str, names: list[str], *columns: pa.Array) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), OUT_ROWS):
        part = [c.slice(at, OUT_ROWS) for c in columns]
        langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part[0]), np.int32)), pa.array([lang])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs, *part], ["lang", *names])


def leading_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, n): occurrences of each word and each pair of words, added up; the word '' counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in chunks(batch):
                ids, words, piece = tokens(text)
                if not len(ids):
                    continue
                total = pa.array([""]), pa.array([len(ids)], pa.int64())
                yield from _rows(lang, ["phrase", "n"], *total)
                yield from _rows(lang, ["phrase", "n"], words, pa.array(np.bincount(ids, minlength=len(words))))
                joined = np.flatnonzero(piece[1:] == piece[:-1])
                pairs, times = np.unique(ids[joined].astype(np.int64) * len(words) + ids[joined + 1], return_counts=True)
                yield from _rows(lang, ["phrase", "n"], _phrases(words, list(np.divmod(pairs, len(words)))), pa.array(times))

    counted = texts.mapInArrow(run, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], np.uint64)


def _pair_bits(lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The filter's bit of pairs of words, given by their hashes."""
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second + np.uint64(xxhash.xxh64_intdigest(lang))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(64 - FILTER_BITS)


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """A bitmap of 8 MB, whatever the corpus: the bits of all given pairs (lang, phrase) are set.

    It only saves rows on their way to the sort; a pair let through by chance is counted
    and abandoned there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                part = batch.filter(pc.equal(batch.column(0), lang))
                words = pc.list_flatten(pc.split_pattern(part.column(1), " ")).dictionary_encode()
                hashes = _word_hashes(words.dictionary)[words.indices.to_numpy()]
                bits = np.unique(_pair_bits(lang, hashes[0::2], hashes[1::2])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits)], ["bit"])

    # Buckets of bitmaps number from one and hold 4096 bytes each.
    bits = pairs.mapInArrow(run, "bit long").withColumn("bit", F.col("bit") + 1)
    packed = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    whole = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in packed.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return whole


def suffixes(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, suffix, n): the suffixes of three or four words that start with two frequent pairs.

    A suffix ends with its piece, at ``DEPTH`` words, or before the first pair that the
    filter knows to be infrequent, as no frequent phrase has such a pair. Equal
    suffixes of about a megabyte of text are one row already.
    """
    held = texts.sparkSession.sparkContext.broadcast(pair_filter(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = held.value
        for batch in batches:
            for lang, text in chunks(batch):
                ids, words, piece = tokens(text)
                if len(ids) < 3:
                    continue
                hashes = _word_hashes(words)[ids]
                bit = _pair_bits(lang, hashes[:-1], hashes[1:]).astype(np.int64)
                good = (piece[1:] == piece[:-1]) & ((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)
                at = np.flatnonzero(good[:-1] & good[1:])
                if not len(at):
                    continue
                after = np.concatenate([good[2:], [False]])[at]
                fourth = np.where(after, ids[np.minimum(at + 3, len(ids) - 1)], -1).astype(np.int64)
                size = np.int64(len(words) + 1)
                heads, head = np.unique(ids[at].astype(np.int64) * size + ids[at + 1], return_inverse=True)
                tails, tail = np.unique(ids[at + 2].astype(np.int64) * size + fourth + 1, return_inverse=True)
                both, times = np.unique(head.astype(np.int64) * len(tails) + tail, return_counts=True)
                head, tail = heads[both // len(tails)], tails[both % len(tails)]
                parts = [head // size, head % size, tail // size, tail % size - 1]
                yield from _rows(lang, ["suffix", "n"], _phrases(words, parts), pa.array(times))

    return texts.mapInArrow(run, "lang string, suffix string, n long")


def equal_partitions(words: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers, sizes) of the partitions of equal leading words that weigh ``least`` or more.

    Multikey quicksort of the rows of ``words`` (-1 after a suffix's end), all partitions
    of a round at once: each is divided three ways by its middle pointer's word at its
    depth; the equal part is counted and goes on one word deeper, the others at the same
    depth, and parts lighter than ``least`` are abandoned.
    """
    pointers = np.arange(len(words))
    start, depth = np.zeros(min(1, len(words)), np.int64), np.zeros(min(1, len(words)), np.int64)
    while len(start):
        sizes = np.diff(np.append(start, len(pointers)))
        owner = np.repeat(np.arange(len(start)), sizes)
        key = words[pointers, depth[owner]]
        side = np.sign(key - key[start + sizes // 2][owner]) + 1
        counts = np.bincount(owner * 3 + side, minlength=3 * len(start))
        goal = np.cumsum(counts) - counts
        by_side = counts.reshape(-1, 3)
        shift = goal.reshape(-1, 3) - (np.cumsum(by_side, 0) - by_side)
        ordered = np.empty_like(pointers)
        for s in range(3):
            mine = np.flatnonzero(side == s)
            ordered[shift[owner[mine], s] + np.arange(len(mine))] = pointers[mine]
        parts = np.flatnonzero(counts)
        weigh = np.add.reduceat(weights[ordered], goal[parts])
        deep, equal = depth[parts // 3], parts % 3 == 1
        ended = words[ordered[goal[parts]], deep] < 0
        heavy = (weigh >= least) & ~(equal & ended)
        for d in np.unique(deep[heavy & equal]):
            chosen = heavy & equal & (deep == d)
            yield int(d) + 1, ordered[goal[parts[chosen]]], weigh[chosen]
        deep = deep + equal
        on = heavy & (deep < words.shape[1])
        kept = parts[on]
        pointers = ordered[np.repeat(on, counts[parts])]
        start = np.cumsum(counts[kept]) - counts[kept]
        depth = deep[on]


def _sorted_counts(lang: str, rows: list[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(rows).combine_chunks()
    split = pc.split_pattern(table.column("suffix").combine_chunks(), " ")
    lengths = pc.list_value_length(split).to_numpy()
    coded = pc.list_flatten(split).dictionary_encode()
    words = np.full((len(lengths), DEPTH), -1, np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    words[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = coded.indices.to_numpy()
    for depth, at, sizes in equal_partitions(words, table.column("n").to_numpy(), least):
        if depth > 2:
            parts = [words[at, k] for k in range(depth)]
            yield from _rows(lang, ["phrase", "n"], _phrases(coded.dictionary, parts), pa.array(sizes))


def deep_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of three and four words that occur ``least`` times or more.

    Suffixes are routed by their three leading words, so that all of a phrase meet in one
    task, and a frequent pair is dealt out by what follows it. A task sorts
    the routes it has in runs of about a million pointers that end between two routes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            keys = list(zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])))
            edges = [k for k in range(len(keys)) if keys[k] != (keys[k - 1] if k else last)] + [len(keys)]
            done = 0
            for edge in edges:
                if edge > done:
                    held.append(batch.slice(done, edge - done))
                    size, done = size + edge - done, edge
                if edge < len(keys) and held:
                    before, after = held[-1].column(0)[0].as_py(), keys[edge][0]
                    if before != after or size >= ROUTE_ROWS:
                        yield from _sorted_counts(before, held, least)
                        held, size = [], 0
            last = keys[-1] if keys else last
        if held:
            yield from _sorted_counts(held[0].column(0)[0].as_py(), held, least)

    leading = F.substring_index("suffix", " ", 3)
    routed = rows.repartition("lang", leading).select("lang", F.xxhash64(leading).alias("route"), "suffix", "n")
    return routed.sortWithinPartitions("lang", "route").mapInArrow(run, "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all phrases of up to four words that occur ``least`` times, (lang, n) of all words), written."""
    # Pieces end at lines, so lines can go to Python by themselves: its batches are counted in rows.
    texts = docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"), F.explode(F.split(docs[text_col], "\n")).alias("text")
    ).select("lang", F.col("text").cast("binary").alias("text"))
    leading = written(leading_words(texts).where((F.col("n") >= least) | (F.col("phrase") == "")), "leading-words")
    pairs = leading.where(F.instr("phrase", " ") > 0).select("lang", "phrase")
    deep = deep_counts(suffixes(texts, pairs), least)
    grams = written(leading.where("phrase <> ''").unionByName(deep), "phrase-counts")
    return grams, leading.where("phrase = ''").select("lang", "n")


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def scored(grams: DataFrame, words: int = DEPTH) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more by their weakest cut."""
    candidates = grams.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"))
    size = F.size(_words(F.col("phrase")))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.explode(F.array(
            F.struct(F.lit(0).alias("side"), F.expr("substring_index(phrase, ' ', k)").alias("part")),
            F.struct(F.lit(1).alias("side"), F.expr("substring_index(phrase, ' ', k - size(split(phrase, ' ')))").alias("part")),
        )).alias("p"),
    ).select("lang", "phrase", "a", "k", "p.side", "p.part")
    known = grams.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    halves = cuts.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    best = halves.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def inside_longer(grams: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the greatest count of a longer phrase that holds all words of ``phrase`` in a row."""
    longer = grams.where(F.size(_words(F.col("phrase"))) > 2).select("lang", _words(F.col("phrase")).alias("w"), "n")
    size = F.size("w")
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda many: F.transform(F.sequence(F.lit(1), size - many + 1), lambda at: F.array_join(F.slice("w", at, many), " ")),
    ))
    held = longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n")
    return held.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP,
    percent: int = 80,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Phrases of two to four words that occur ``least`` times within pieces; those inside a
    longer one that has ``percent`` per cent of their count or more are left out. Null texts count as empty,
    documents without a language as those of ``und``; ties are settled by count and
    phrase; repeated rows count as often as they stand there; other columns play no part;
    an empty table gives no rows. All counts are exact; ratios are compared as decimals.
    """
    grams, totals = phrase_counts(docs, text_col, lang_col, least)
    wide = lambda name: F.col(name).cast("decimal(20, 0)")
    kept = (
        scored(grams)
        .join(inside_longer(grams), ["lang", "phrase"], "left")
        .where(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * percent))
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Each salt's best first, so that no task sorts a whole language.
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    few = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top).drop("rank")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
