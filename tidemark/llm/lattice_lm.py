"""Language-model scores from the subword lattice of an existing piece vocabulary."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from math import log, log10

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from tidemark.llm.shared import id_text, written

MARK = "▁"
NORMAL, BYTE = 1, 6
SMOOTHING = 0.5
# The most frequent words are looked up where the documents are read; this bounds
# what a task is sent. All other words are joined by word.
HEAD_WORDS = 100_000
FLUSH = 500_000
# Labels with a model of their own; the documents of rarer labels share one.
COMPONENTS = 16
LOG10 = log(10)


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, with A-Z lower-cased."""
    return (text or b"").lower().split()


class Lattice:
    """All segmentations of words into the pieces of a vocabulary, weighted by their scores.

    The vocabulary is that of a public model file and is never changed. ``logp`` has a
    row of log-probabilities for each model; without it the ranks of the file give one
    (a Zipf curve). A character that is no piece is spelt by its byte pieces. The last
    column is the end of a document.
    """

    def __init__(self, model: bytes, logp: np.ndarray | None = None):
        spec = model_pb.ModelProto()
        spec.ParseFromString(model)
        self.pieces = [p.piece if p.type == NORMAL else "" for p in spec.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.end = len(self.pieces)
        self.usable = np.array([p.type in (NORMAL, BYTE) for p in spec.pieces] + [True])
        if logp is None:
            logp = self.logs(1 / (np.arange(self.end + 1) + 10.0))[None, :]
        self.logp = logp
        self.size = np.array([len(p) for p in self.pieces] + [0], np.int64)
        self.single = {p for p in self.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self.pieces):
            if piece:
                self.automaton.add_word(piece, number)
        self.automaton.make_automaton()

    def logs(self, weights: np.ndarray) -> np.ndarray:
        weights = np.where(self.usable, weights, 0)
        with np.errstate(divide="ignore"):
            return np.log(weights / weights.sum())

    def arcs(self, batch: list[bytes]):
        """(first node of each word, source, target, piece) over the nodes of all words.

        Each place between two characters of a word is a node. Characters to be spelt are
        numbered from ``end`` + 1 and returned as a list of byte pieces.
        """
        units = [MARK + word.decode("utf-8", "replace") for word in batch]
        first = np.cumsum([0, *(len(u) + 1 for u in units)])
        target, piece, spelt, numbers = [], [], [], {}
        for unit, base in zip(units, first.tolist()):
            for last, number in self.automaton.iter(unit):
                target.append(base + last + 1)
                piece.append(number)
            if not self.single.issuperset(unit):
                for at, char in enumerate(unit):
                    if char not in self.single:
                        if char not in numbers:
                            numbers[char] = self.end + 1 + len(spelt)
                            spelt.append([self.bytes[b] for b in char.encode()])
                        target.append(base + at + 1)
                        piece.append(numbers[char])
        target, piece = np.array(target, np.int64), np.array(piece, np.int64)
        size = np.concatenate([self.size, np.ones(len(spelt), np.int64)])
        return first, target - size[piece], target, piece, spelt

    def _weights(self, spelt: list[list[int]]) -> np.ndarray:
        """Log-probabilities by piece (rows), those of spelt characters included."""
        extra = [self.logp[:, parts].sum(axis=1) for parts in spelt]
        return np.concatenate([self.logp.T, np.array(extra).reshape(len(spelt), -1)]) if spelt else self.logp.T

    @staticmethod
    def _levels(place: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
        """Arcs by the place of a node in its word, those of one node together."""
        order = np.lexsort((node, place))
        cuts = np.flatnonzero(np.diff(place[order])) + 1
        yield from np.split(order, cuts) if len(order) else ()

    def _forward(self, first, source, target, weight) -> np.ndarray:
        """Log-probability of every prefix, summed over its segmentations, in log space."""
        alpha = np.full((first[-1], weight.shape[1]), -np.inf)
        alpha[first[:-1]] = 0
        place = target - first[np.searchsorted(first, target, "right") - 1]
        for arcs in self._levels(place, target):
            begins = np.flatnonzero(np.diff(target[arcs], prepend=-1))
            alpha[target[arcs][begins]] = np.logaddexp.reduceat(alpha[source[arcs]] + weight[arcs], begins)
        return alpha

    def scores(self, batch: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of each word, a column for each model."""
        if not batch:
            return np.zeros((0, len(self.logp)))
        first, source, target, piece, spelt = self.arcs(batch)
        return self._forward(first, source, target, self._weights(spelt)[piece])[first[1:] - 1]

    def expected(self, batch: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected, given how often each word occurs (words x models)."""
        total = np.zeros((counts.shape[1], self.end + 1))
        if not batch:
            return total
        first, source, target, piece, spelt = self.arcs(batch)
        weight = self._weights(spelt)[piece]
        alpha = self._forward(first, source, target, weight)
        ends = first[1:] - 1
        beta = np.full(alpha.shape, -np.inf)
        beta[ends] = -alpha[ends]
        word = np.searchsorted(first, source, "right") - 1
        for arcs in self._levels(first[word + 1] - source, source):
            begins = np.flatnonzero(np.diff(source[arcs], prepend=-1))
            beta[source[arcs][begins]] = np.logaddexp.reduceat(beta[target[arcs]] + weight[arcs], begins)
        share = np.exp(alpha[source] + weight + beta[target]) * counts[word]
        for k in range(counts.shape[1]):
            found = np.bincount(piece, share[:, k], minlength=self.end + 1 + len(spelt))
            for number, parts in enumerate(spelt):
                np.add.at(found, parts, found[self.end + 1 + number])
            total[k] = found[: self.end + 1]
        return total


def word_counts(docs: DataFrame, models: int) -> DataFrame:
    """(word, n, c0, c1, ...) of (text, model) rows: occurrences in all documents and by model.

    A null model is a document that is only scored. Every task adds up before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for number, table in tables.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(table), pa.binary()),
                        pa.array([number] * len(table), pa.int32()),
                        pa.array(list(table.values()), pa.int64()),
                    ],
                    ["word", "model", "n"],
                )
            tables.clear()

        for batch in batches:
            for text, number in zip(batch.column(0), batch.column(1).to_pylist()):
                tables[-1 if number is None else number].update(words(text.as_py()))
                if sum(map(len, tables.values())) > FLUSH:
                    yield from out()
        yield from out()

    counted = docs.mapInArrow(run, "word binary, model int, n long")
    return counted.groupBy("word").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("model") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(models)],
    )


def learn(counts: DataFrame, ends: list[int], model: bytes) -> np.ndarray:
    """Log-probabilities of the pieces and the end in each model, by expectation over all training words.

    The expected pieces of every word of the corpus' vocabulary are gathered under the
    existing scores; one number per piece and model comes to the driver.
    """
    spark, start = counts.sparkSession, Lattice(model)
    shared = spark.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(ends))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        total = np.zeros((len(ends), lattice.end + 1))
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                seen = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
                total += lattice.expected(part.column(0).to_pylist(), seen.astype(float))
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.astype(np.int32)), pa.array(at), pa.array(total[k, at])], ["model", "piece", "n"]
        )

    used = counts.where(reduce(Column.__or__, [F.col(c) > 0 for c in names])).select("word", *names)
    gathered = used.mapInArrow(run, "model int, piece long, n double")
    total = np.zeros((len(ends), start.end + 1))
    for k, piece, n in gathered.groupBy("model", "piece").agg(F.sum("n")).collect():
        total[k, piece] = n
    total[:, start.end] = ends
    return np.array([start.logs(row + SMOOTHING) for row in total])


def score_documents(
    docs: DataFrame,
    model: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str | None = "lang",
    folds: int = 5,
    fold: int = 1,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """Score every whole text: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Learns from the documents whose id's CRC-32 leaves another remainder than ``fold``;
    rows without an id are learned from and not held out. Words and the end of each
    document are tokens. ``score`` is the log10 probability of the text, marginal over
    all segmentations: each word of the corpus is scored once, by a forward recursion
    over the pieces that cover it and, as one more way through, the word as a whole with
    its share of the training tokens. The whole word weighs what training tokens seen
    once leave over. Pieces never reach over white space, so the recursion of a
    document is the product over its words. Training documents of each label have a
    model of their own, and the score is marginal over these too; the labels of scored
    documents are not looked at. ``base_score`` is that of the smoothed word frequencies.

    Null and empty texts are the end alone. If there is nothing to learn from, no
    token is known and the existing scores are used. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.coalesce(id_text(id_col) % folds == fold, F.lit(False))
    label = F.coalesce(docs[label_col].cast("string"), F.lit("")) if label_col else F.lit("")
    narrow = docs.select(
        docs[id_col].cast("long").alias("id"),
        held.alias("held_out"),
        docs[text_col].cast("binary").alias("text"),
        label.alias("label"),
    )
    seen = narrow.where("not held_out").groupBy("label").count().orderBy(F.desc("count"), "label")
    labels = [row["label"] for row in seen.limit(COMPONENTS - 1).collect()] or [""]
    own = F.lit(len(labels))
    for k, name in enumerate(labels):
        own = F.when(F.col("label") == name, k).otherwise(own)
    number = F.when(~F.col("held_out"), own)
    models = len(labels) + 1
    sized = dict(narrow.where("not held_out").groupBy(number.alias("k")).count().collect())
    ends = [sized.get(k, 0) for k in range(models)]
    counts = written(word_counts(narrow.select("text", number.alias("model")), models), "words")
    names = [f"c{k}" for k in range(models)]
    c = reduce(Column.__add__, [F.col(name) for name in names])
    sums = counts.agg(
        F.sum((c > 0).cast("long")),
        *[F.sum(name) for name in names],
        *[F.sum((F.col(name) == 1).cast("long")) for name in names],
    ).first()
    sums = [n or 0 for n in sums]
    known_kinds, tokens, once = sums[0], np.array(sums[1 : models + 1]) + ends, np.array(sums[models + 1 :])
    train_tokens, n_docs = int(tokens.sum()), sum(ends)
    norm = log(train_tokens + 0.5 * (known_kinds + (n_docs > 0) + 1))
    used = [k for k in range(models) if tokens[k]] or [0]
    learned = learn(counts, ends, model)[used] if n_docs else Lattice(model).logp
    whole = 1 - (once[used] + 1) / (tokens[used] + 2)
    share = np.maximum(tokens[used], 1)
    shared = spark.sparkContext.broadcast((model, learned))

    def log_mixed(counted: np.ndarray, subword: np.ndarray) -> np.ndarray:
        """log10 of the whole word's share and the pieces' probability together."""
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(whole * counted / share), np.log(1 - whole) + subword) / LOG10

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                counted = np.column_stack([x.to_numpy(zero_copy_only=False) for x in part.columns[2:]])
                found = log_mixed(counted[:, used], lattice.scores(part.column(0).to_pylist()))
                total = counted.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(total > 0),
                        pa.array((np.log(total + 0.5) - norm) / LOG10),
                        *(pa.array(found[:, k].copy()) for k in range(len(used))),
                    ],
                    ["word", "n", "known", "base", *scores],
                )

    scores = [f"s{k}" for k in range(len(used))]
    doubles = ", ".join(f"{s} double" for s in scores)
    rated = written(
        counts.select("word", "n", *names).mapInArrow(rate, f"word binary, n long, known boolean, base double, {doubles}"),
        "rated-words",
    )
    # How many words have each count tells the least count whose words are few enough.
    least, held = None, 0
    for row in rated.groupBy("n").count().orderBy(F.desc("n")).limit(head_words).collect():
        held += row["count"]
        if held > head_words:
            break
        least = row["n"]
    top = rated.where(F.col("n") >= least).collect() if least else []
    table = np.array([[r["known"], r["base"], *(r[s] for s in scores)] for r in top]).reshape(-1, 2 + len(scores))
    end = np.array(
        [n_docs > 0, (log(n_docs + 0.5) - norm) / LOG10, *log_mixed(np.array(ends)[used], learned[:, -1])]
    )
    head = spark.sparkContext.broadcast(({bytes(r["word"]): k for k, r in enumerate(top)}, table, end))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table, end = head.value
        for batch in batches:
            lengths, sums, tails = [], [], []
            for text in batch.column(2):
                found = words(text.as_py())
                at = [place.get(word, -1) for word in found]
                tail = Counter(word for word, k in zip(found, at) if k < 0)
                at = np.array(at, np.int64)
                lengths.append(len(found) + 1)
                sums.append(end + table[at[at >= 0]].sum(axis=0))
                tails.append([{"word": w, "n": n} for w, n in tail.items()])
            sums = np.array(sums).reshape(-1, len(end))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(lengths, pa.int64()),
                    *(pa.array(sums[:, k].copy()) for k in range(sums.shape[1])),
                    pa.array(tails, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
                ],
                ["id", "held_out", "n_tokens", "known", "base", *scores, "tail"],
            )

    heads = narrow.select("id", "held_out", "text").mapInArrow(
        add_up,
        f"id long, held_out boolean, n_tokens long, known double, base double, {doubles}, "
        "tail array<struct<word: binary, n: long>>",
    )
    heads = written(heads.withColumn("key", F.monotonically_increasing_id()), "heads")
    sums = ["known", "base", *scores]
    rest = (
        heads.select("key", F.explode("tail").alias("t")).select("key", "t.word", F.col("t.n").alias("times"))
        .join(rated.drop("n"), "word")
        .groupBy("key")
        .agg(*[F.sum(F.col("times") * F.col(s).cast("double")).alias(f"more_{s}") for s in sums])
    )
    both = heads.drop("tail").join(rest, "key", "left")
    both = both.select(
        "id", "held_out", "n_tokens", *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0.0))).alias(s) for s in sums]
    )
    logs = F.array(
        *[F.col(s) + F.lit(log10(max(ends[k], 1) / max(n_docs, 1))) for s, k in zip(scores, used)]
    )
    most = F.array_max(logs)
    score = most + F.log10(F.aggregate(logs, F.lit(0.0), lambda total, x: total + F.pow(F.lit(10.0), x - most)))
    return both.select(
        "id", "held_out", "n_tokens",
        F.round("known").cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        score.alias("score"),
    )
