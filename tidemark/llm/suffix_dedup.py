"""Removal of byte strings that an earlier document has, by difference covers over pieces of equal anchors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_folder, written

LENGTH = 50
GRAM = 26
# Bytes of text in a row of parts, and of them those that are hashed at once.
PART = 1 << 22
CHUNK = 1 << 19
# Bytes of pieces that are sorted and named at once, besides those of one gram.
SEARCH = 1 << 20
LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _numbers(x: np.ndarray) -> bytes:
    """Whole numbers, all first bytes before all second ones, compressed."""
    return _squeezed(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _as_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_plain(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _steps(x: np.ndarray) -> bytes:
    return _numbers(np.diff(x, prepend=0))


def _as_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_as_numbers(data))


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _as_bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def _laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, owner, place) of runs of these lengths, one after the other."""
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return first, owner, np.arange(len(owner)) - first[owner]


def gram_hashes(text: bytes, size: int = GRAM) -> np.ndarray:
    """A hash of each run of ``size`` bytes, from running sums of a polynomial."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    power, back = np.full(len(data), _BASE), np.full(len(data), _INVERSE)
    power[0] = back[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(data * np.multiply.accumulate(power))])
    mixed = (sums[size:] - sums[:-size]) * np.multiply.accumulate(back)[: len(data) - size + 1]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(31))


def anchors(data: bytes, lens: np.ndarray, searched: np.ndarray, gram_size: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram, document, first, last window) of the least gram of every window of 50 bytes in the searched documents.

    The documents lie one after the other in ``data``. Equal windows have equal least
    grams, so a window that occurs twice has a gram that does. Each gram owns a run of
    windows. A gram is known by 48 bits of its hash, mixed once more, since least
    hashes are small and would fall into the first buckets.
    """
    ends = np.cumsum(lens)
    cuts = np.flatnonzero(np.diff(ends // CHUNK, prepend=-1))
    found = [[np.zeros(0, np.int64)] * 4]
    for a, b in zip(cuts, [*cuts[1:], len(lens)]):
        start, stop = int(ends[a] - lens[a]), int(ends[b - 1])
        if stop - start < LENGTH:
            continue
        least, reach, span = gram_hashes(data[start:stop], gram_size), 1, LENGTH - gram_size + 1
        while 2 * reach <= span:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        rest = span - reach
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        owner = np.repeat(np.arange(a, b), lens[a:b])[: len(least)]
        inside = searched[owner] & (np.arange(start + LENGTH, start + LENGTH + len(least)) <= ends[owner])
        new = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        edges = np.flatnonzero(new) + 1
        first, last = np.concatenate([[0], edges]), np.concatenate([edges - 1, [len(least) - 1]])
        kept = inside[first]
        first, last = first[kept], last[kept]
        found.append([(least[first] * _BASE >> np.uint64(16)).astype(np.int64), owner[first], start + first, start + last])
    return tuple(np.concatenate(x) for x in zip(*found))


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a gram; it never falls while grams ascend."""
    return (gram >> 16) * buckets >> 32


def _by_bucket(grams: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted grams."""
    found, starts = np.unique(_bucket(grams, buckets), return_index=True)
    return zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(grams)])


def _searched(row: dict) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(data, lens, place, whether it is searched) of a part's documents."""
    lens = np.array(row["lens"], np.int64)
    searched = lens >= LENGTH
    searched[row["copies"] or []] = False
    return _plain(row["data"]), lens, _places(row), searched


def _places(row: dict) -> np.ndarray:
    return np.array([LAST if x is None else x for x in row["ids"]], np.int64)


def _each(make):
    """``make`` gives record batches for a row of parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from make(batch.slice(k, 1).to_pylist()[0])

    return run


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def parts(docs: DataFrame, id_col: str, text_col: str, part_bytes: int) -> DataFrame:
    """(part, ids, lens, data): documents in rows of about four megabytes, in buckets by ``part``.

    The whole texts are written once, compressed, and later steps join what they find to them
    by ``part`` without a shuffle of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(key)
                texts.append(text)
                size += len(text)
                if size >= part_bytes or len(ids) >= 1 << 16:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield made(ids, texts)

    def made(ids, texts):
        kind = pa.list_(pa.int64())
        row = {"ids": pa.array([ids], kind), "lens": pa.array([[len(t) for t in texts]], kind)}
        return _batch(row | {"data": pa.array([_squeezed(b"".join(texts))], pa.binary())})

    spark = docs.sparkSession
    read = docs.select(docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    rows = read.mapInArrow(run, "ids array<long>, lens array<long>, data binary")
    name = f"tidemark_parts_{uuid.uuid4().hex}"
    writer = rows.withColumn("part", F.monotonically_increasing_id()).write.format("parquet")
    writer = writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortBy("part")
    writer.option("path", shared_folder(spark, "parts")).saveAsTable(name)
    return spark.table(name)


def copies(texts: DataFrame) -> DataFrame:
    """(part, copies): the documents whose whole text an earlier one has, by their number in the part."""

    def digests(row):
        import hashlib

        data, lens, place, long = _searched(row | {"copies": None})
        ends, at = np.cumsum(lens), np.flatnonzero(long)
        found = [hashlib.sha256(data[ends[k] - lens[k] : ends[k]]).digest() for k in at]
        columns = {"part": pa.array(np.full(len(at), row["part"])), "nth": pa.array(at), "place": pa.array(place[at])}
        yield _batch(columns | {"digest": pa.array(found, pa.binary())})

    found = texts.mapInArrow(_each(digests), "part long, nth long, place long, digest binary")
    found = written(found, "digests")
    firsts = found.groupBy("digest").agg(F.min("place").alias("smallest"))
    later = found.join(firsts, "digest").where("place > smallest")
    return written(later.groupBy("part").agg(F.collect_list("nth").alias("copies")), "copies")


def shared_grams(texts: DataFrame, buckets: int) -> DataFrame:
    """(part, shared): for a part's different grams in order, bits that say whether another text has them too.

    A part asks for each of its grams once, so a frequent gram is one entry a part.
    """

    def asked(row):
        data, lens, _, searched = _searched(row)
        gram, doc, _, _ = anchors(data, lens, searched)
        grams, first, which = np.unique(gram, return_index=True, return_inverse=True)
        several = np.zeros(len(grams), bool)
        several[which[doc != doc[first][which]]] = True
        found = [(b, _steps(grams[a:z]), _bits(several[a:z])) for b, a, z in _by_bucket(grams, buckets)]
        columns = list(zip(*found)) or [[], [], []]
        yield _batch({
            "part": pa.array([row["part"]] * len(found), pa.int64()), "bucket": pa.array(columns[0], pa.int64()),
            "grams": pa.array(columns[1], pa.binary()), "several": pa.array(columns[2], pa.binary()),
        })

    def answered(table: pa.Table) -> pa.Table:
        grams = [_as_steps(x) for x in table["grams"].to_pylist()]
        several = np.concatenate([_as_bits(x, len(g)) for x, g in zip(table["several"].to_pylist(), grams)])
        _, which, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[which[several]] = True
        bits = [_bits(x) for x in np.split(shared[which], np.cumsum([len(g) for g in grams])[:-1])]
        return pa.table({"part": table["part"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    rows = texts.mapInArrow(_each(asked), "part long, bucket long, grams binary, several binary")
    found = rows.groupBy("bucket").applyInArrow(answered, "part long, bucket long, bits binary")
    return found.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("shared"))


def pieces(texts: DataFrame, buckets: int) -> DataFrame:
    """(part, bucket, grams, places, sizes, data): the stretches whose windows may occur in two documents.

    A piece holds the windows of one anchor whose gram another text has, and all their
    bytes; windows of other grams cannot occur in two documents, and are left out; nothing
    else is. Equal windows have equal grams, so they meet in one bucket. A part gives
    each different piece once, with the least place of its documents; its row of bucket -1 has
    the starts of all pieces, which of the different ones each is, and the windows of those.
    """

    def cut(row):
        data, lens, place, searched = _searched(row)
        gram, doc, first, last = anchors(data, lens, searched)
        grams, which = np.unique(gram, return_inverse=True)
        answers = {x["bucket"]: x["bits"] for x in row["shared"] or ()}
        bits = [_as_bits(answers[b], z - a) for b, a, z in _by_bucket(grams, buckets)]
        shared = np.concatenate([np.zeros(0, bool), *bits])[which]
        gram, doc, first, last = gram[shared], doc[shared], first[shared], last[shared]
        order = np.argsort(gram, kind="stable")
        gram, doc, first, last = gram[order], doc[order], first[order], last[order]
        known: dict[bytes, int] = {}
        each = (known.setdefault(data[a:b], len(known)) for a, b in zip(first.tolist(), (last + LENGTH).tolist()))
        which = np.fromiter(each, np.int64, len(gram))
        _, at = np.unique(which, return_index=True)
        least = np.full(len(known), LAST)
        np.minimum.at(least, which, place[doc])
        gram, sizes, texts = gram[at], (last - first + 1)[at], list(known)
        rows = [(-1, b"", _steps(first), _numbers(which), _numbers(sizes))]
        for b, a, z in _by_bucket(gram, buckets):
            rows.append((b, _steps(gram[a:z]), _steps(least[a:z]), _numbers(sizes[a:z]), _squeezed(b"".join(texts[a:z]))))
        columns = dict(zip(("bucket", "grams", "places", "sizes", "data"), zip(*rows)))
        kinds = [pa.int64()] + [pa.binary()] * 4
        found = {k: pa.array(v, kind) for (k, v), kind in zip(columns.items(), kinds)}
        yield _batch({"part": pa.array([row["part"]] * len(rows), pa.int64())} | found)

    joined = texts.join(shared_grams(texts, buckets), "part", "left")
    schema = "part long, bucket long, grams binary, places binary, sizes binary, data binary"
    return written(joined.mapInArrow(_each(cut), schema), "pieces")


def _named(*columns: np.ndarray) -> np.ndarray:
    """The rank of each row among the different ones, in order of the columns."""
    rows, top = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        size = int(column.max(initial=0)) + 1
        if top * size >= 1 << 62:
            rows = np.unique(rows, return_inverse=True)[1]
            top = int(rows.max(initial=0)) + 1
        rows, top = rows * size + column, top * size
    return np.unique(rows, return_inverse=True)[1]


def repeated_windows(data: bytes, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For all windows of pieces: whether they also start in a piece of smaller place.

    ``data`` has the pieces one after the other. The six bytes (two triples) at each
    place of the difference cover {1, 2} modulo 3 are sorted and named, then
    triples of names (18 bytes), then triples of those (48 bytes). Two windows meet at
    sampled places after none, one or two bytes, so each window is put in order by
    the name at two of the three offsets and the two bytes that it leaves; neighbours
    in that order are compared, and a run of equal ones gives its least place.
    """
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    _, owner, at = _laid_out(size)
    room, names = size[owner] - at, raw
    where = np.flatnonzero(at % 3 != 0)
    for wide, offsets in ((6, range(6)), (18, (0, 6, 12)), (48, (0, 18, 30))):
        where = where[room[where] >= wide]
        named = _named(*(names[where + k] for k in offsets))
        names = np.zeros(len(raw), np.int64)
        names[where] = named
    window = np.flatnonzero(room >= LENGTH)
    keys, whose = [], []
    for offset in range(3):
        chosen = np.flatnonzero((at[window] + offset) % 3 != 0)
        start = window[chosen]
        left = [start + k for k in (*range(offset), *range(offset + 48, LENGTH))]
        keys.append(((names[start + offset] * 3 + offset) << 8 | raw[left[0]]) << 8 | raw[left[1]])
        whose.append(chosen)
    keys, whose = np.concatenate(keys), np.concatenate(whose)
    order = np.argsort(keys)
    keys, whose = keys[order], whose[order]
    own = place[owner[window]]
    low = own.copy()
    if len(keys):
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        least = np.minimum.reduceat(own[whose], np.flatnonzero(new))
        np.minimum.at(low, whose, least[np.cumsum(new) - 1])
    return low < own


def _runs(gram: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces in order of their grams: all pieces of a few grams, about ``most`` bytes."""
    last = np.flatnonzero(np.diff(gram, append=-1))
    ends = np.cumsum(size)[last]
    cuts = (last[np.flatnonzero(np.diff(ends // most, append=-1))] + 1).tolist()
    return zip([0, *cuts], cuts)


def repeats_by_gram(
    texts: list[bytes], gram: np.ndarray, place: np.ndarray, most: int = SEARCH, gram_size: int = GRAM
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, whether their windows also start in a piece of smaller place), a few grams at a time.

    Equal windows have equal grams, so nothing is lost between runs. Pieces whose gram no
    other piece has are left out. Where one gram has many different pieces, they are cut
    again by longer grams, at last by whole windows, so that ``most`` bounds a search.
    """
    _, same, times = np.unique(gram, return_inverse=True, return_counts=True)
    order = np.argsort(same, kind="stable")
    order = order[times[same[order]] > 1]
    size = np.array([len(x) for x in texts], np.int64)
    for a, b in _runs(same[order], size[order], most):
        chosen = order[a:b]
        data = b"".join([texts[k] for k in chosen])
        if len(data) > 2 * most and gram_size < LENGTH:
            yield chosen, _cut_again(data, size[chosen], place[chosen], most, (gram_size + LENGTH + 1) // 2)
        else:
            yield chosen, repeated_windows(data, size[chosen], place[chosen])


def _cut_again(data: bytes, size: np.ndarray, place: np.ndarray, most: int, gram_size: int) -> np.ndarray:
    """What ``repeated_windows`` gives, by pieces of longer grams."""
    gram, owner, first, last = anchors(data, size, np.ones(len(size), bool), gram_size)
    _, same, times = np.unique(gram, return_inverse=True, return_counts=True)
    several = times[same] > 1
    gram, owner, first, last = gram[several], owner[several], first[several], last[several]
    cut = (data[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist()))
    goes = whole_or_repeated(cut, gram, place[owner], most, gram_size)
    # Each piece has 49 bytes that start no window.
    _, piece, nth = _laid_out(last - first + 1)
    gone = np.zeros(len(data) - (LENGTH - 1) * len(size), bool)
    gone[(first - (LENGTH - 1) * owner)[piece] + nth] = goes
    return gone


def whole_or_repeated(
    cut: Iterator[bytes], gram: np.ndarray, place: np.ndarray, most: int = SEARCH, gram_size: int = GRAM
) -> np.ndarray:
    """For all windows of pieces: whether they go.

    All of a piece goes that an earlier document has whole. Of the different pieces only
    those are searched whose gram stands in several of them.
    """
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(x, len(known)) for x in cut), np.int64, len(gram))
    _, at = np.unique(which, return_index=True)
    low = np.full(len(known), LAST)
    np.minimum.at(low, which, place)
    texts = list(known)
    windows = np.array([len(x) - LENGTH + 1 for x in texts], np.int64)
    first = np.cumsum(windows) - windows
    gone = np.zeros(int(windows.sum()), bool)
    for chosen, goes in repeats_by_gram(texts, gram[at], low, most, gram_size):
        _, owner, nth = _laid_out(windows[chosen])
        gone[first[chosen][owner] + nth] = goes
    _, owner, nth = _laid_out(windows[which])
    return gone[first[which][owner] + nth] | (place > low[which])[owner]


def _repeats(table: pa.Table) -> pa.Table:
    """(part, bucket, bits) for a bucket of pieces: whether the windows of each part's pieces go."""
    read = lambda name, decode: [decode(x) for x in table[name].to_pylist()]
    by_part = read("sizes", _as_numbers)

    def cut():
        for sizes, data in zip(by_part, table["data"].to_pylist()):
            data, ends = _plain(data), np.cumsum(sizes + LENGTH - 1).tolist()
            yield from (data[a:b] for a, b in zip([0, *ends], ends))

    bits = whole_or_repeated(cut(), np.concatenate(read("grams", _as_steps)), np.concatenate(read("places", _as_steps)))
    counts = [int(s.sum()) for s in by_part]
    found = [_bits(x) for x in np.split(bits, np.cumsum(counts)[:-1])]
    return pa.table({
        "part": table["part"], "bucket": table["bucket"],
        "bits": pa.array(found, pa.binary()), "windows": pa.array(counts, pa.int64()),
    })


def _without(row: dict) -> Iterator[pa.RecordBatch]:
    """The documents of a part without what goes."""
    lens, place = np.array(row["lens"], np.int64), _places(row)
    data = np.frombuffer(_plain(row["data"]), np.uint8)
    starts, doc, _ = _laid_out(lens)
    begins, which, sizes = _as_steps(row["starts"]), _as_numbers(row["which"]), _as_numbers(row["windows"])
    # Bits are by bucket, whose pieces follow each other.
    lasts = np.cumsum(sizes)
    bits, done = [np.zeros(0, bool)], 0
    for x in row["bits"] or ():
        bits.append(_as_bits(x["bits"], x["windows"]))
        done += x["windows"]
    assert done == (lasts[-1] if len(lasts) else 0), "an answer is missing"
    least = np.full(len(sizes), LAST)
    np.minimum.at(least, which, place[doc[begins]])
    _, owner, nth = _laid_out(sizes[which])
    goes = np.concatenate(bits)[(lasts - sizes)[which][owner] + nth] | (place[doc[begins]] > least[which])[owner]
    change = np.zeros(len(data) + 1, np.int64)
    at = (begins[owner] + nth)[goes]
    np.add.at(change, at, 1)
    np.add.at(change, at + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    gone[np.isin(doc, row["copies"] or [])] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = edge[-1] = True
    begin = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
    end = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
    base = starts[doc[begin]]
    pairs = np.stack([begin - base, end - base], axis=1).ravel()
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(pairs) + 1, 2), pa.int32()), pa.array(pairs))
    runs = np.concatenate([[0], np.cumsum(np.bincount(doc[begin], minlength=len(lens)))])
    stays = np.concatenate([[0], np.cumsum(~gone)])
    text, cuts = data[~gone].tobytes(), stays[np.concatenate([starts, [len(data)]])].tolist()
    yield _batch({
        "id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(lens),
        "kept": pa.array([text[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
        "spans": pa.ListArray.from_arrays(pa.array(runs, pa.int32()), inner),
    })


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, spans) of every document.

    ``kept`` are the UTF-8 bytes without those covered by a string of 50 bytes that
    also starts in a document with a smaller id; ``spans`` the removed runs as [from, to).
    Of equal texts only those of the smallest id are searched, the others go whole (or
    stay, below 50 bytes). Null counts as empty; rows without an id come after all others
    and, like rows of the same id, take nothing from each other; an empty table gives
    no rows.
    """
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = parts(docs, id_col, text_col, part_bytes)
    texts = texts.join(copies(texts), "part", "left")
    cut = pieces(texts, buckets)
    found = cut.where("bucket >= 0").groupBy("bucket").applyInArrow(_repeats, "part long, bucket long, bits binary, windows long")
    marks = written(found.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits", "windows"))).alias("bits")), "marks")
    notes = cut.where("bucket = -1").selectExpr("part", "places starts", "sizes which", "data windows")
    done = texts.join(notes, "part").join(marks, "part", "left").mapInArrow(
        _each(_without), "id long, n_bytes long, kept binary, spans array<array<long>>"
    )
    return done.select(
        "id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "kept", "spans",
    )
