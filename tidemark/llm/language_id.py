"""Language identification: each document as a mixture of languages, fitted by EM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import id_text

BUCKETS = 1 << 15
SMOOTHING = 0.5
ROUNDS = 20
# A language joins a document's set if the log-likelihood grows by more than this
# many times log(n-grams). Neighbouring n-grams overlap, so it is above the usual 0.5.
PENALTY = 3.0
UNKNOWN = "und"

# All ASCII that is no letter becomes a blank.
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, without those around a blank."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" ", np.uint8)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    mixed = (wide[:-2] * np.uint32(2654435761) ^ wide[1:-1] * np.uint32(40503) * np.uint32(65599)) + (
        wide[2:] * np.uint32(2246822519)
    )
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2654435769)
    return (mixed >> np.uint32(17)).astype(np.int64)[data[1:-1] != 32]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n) over whole texts; every task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = grams(text.as_py())
                if lang not in tables:
                    tables[lang] = np.zeros(BUCKETS, np.int64)
                tables[lang] += np.bincount(found, minlength=BUCKETS)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at), pa.array(table[at])], ["lang", "gram", "n"]
            )

    labelled = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    counted = labelled.select(docs[lang_col].cast("string"), docs[text_col].cast("string")).mapInArrow(
        run, "lang string, gram long, n long"
    )
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of the n-gram buckets by language: at most languages x 32,768 numbers."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp

    @classmethod
    def train(cls, docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
        """Learn from all given rows with text and language."""
        per_lang = gram_counts(docs, lang_col, text_col).groupBy("lang").agg(
            F.sort_array(F.collect_list(F.struct("gram", "n"))).alias("grams")
        )
        rows = sorted(per_lang.collect(), key=lambda r: r["lang"])
        counts = np.zeros((BUCKETS, len(rows)))
        for k, row in enumerate(rows):
            for gram, n in row["grams"]:
                counts[gram, k] = n
        logp = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
        return cls([r["lang"] for r in rows], logp)

    def _fit(self, logp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the languages (columns) and the log-likelihood of the mixture."""
        top = logp.max(axis=1, keepdims=True)
        weight = np.exp(logp - top)
        share = np.full(logp.shape[1], 1 / logp.shape[1])
        for _ in range(ROUNDS):
            joint = weight * share
            new = (n / joint.sum(axis=1)) @ joint / n.sum()
            if np.abs(new - share).max() < 1e-4:
                share = new
                break
            share = new
        return share, float(n @ (np.log((weight * share).sum(axis=1)) + top[:, 0]))

    def mixture(self, text: str | None) -> dict[str, float]:
        """The languages of a text with their shares; empty without a letter or a model.

        The mixture of all languages is fitted first. Languages are then added to the
        best single one, largest share first, while the penalised likelihood grows.
        """
        if not self.langs or not has_letter(text):
            return {}
        seen = np.bincount(grams(text), minlength=BUCKETS)
        at = np.flatnonzero(seen)
        if not len(at):
            return {}
        n, logp = seen[at].astype(float), self.logp[at]
        single = n @ logp
        best = int(single.argmax())
        chosen, share, likelihood = [best], np.ones(1), float(single[best])
        price = PENALTY * np.log(n.sum() + 1)
        whole, most = self._fit(logp, n)
        if most - likelihood > price:
            for lang in np.argsort(-whole, kind="stable").tolist():
                if lang in chosen:
                    continue
                new_share, new = self._fit(logp[:, [*chosen, lang]], n)
                if new - likelihood <= price:
                    break
                chosen, share, likelihood = [*chosen, lang], new_share, new
        return {self.langs[k]: float(s) for k, s in zip(chosen, share)}


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``mixture`` to the documents.

    ``lang_pred`` is the language with the largest share (of equal ones the first by
    name), ``score`` its share, ``mixture`` the shares of the chosen set. A text that
    is null or has no letter gets ``und``, score 0 and an empty mixture; so does any
    text if the model saw no labelled row. Texts are read whole. Columns of these
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))

    @F.pandas_udf("struct<lang_pred string, score double, mixture map<string, double>>")
    def judge(texts):
        import pandas as pd

        known = Model(*shared.value)
        found = [known.mixture(text) for text in texts]
        best = [min(m, key=lambda k: (-m[k], k)) if m else UNKNOWN for m in found]
        return pd.DataFrame(
            {"lang_pred": best, "score": [m.get(b, 0.0) for m, b in zip(found, best)], "mixture": found}
        )

    return docs.withColumn("_judged", judge(F.col(text_col).cast("string"))).select(
        *[docs[c] for c in docs.columns if c not in ("lang_pred", "score", "mixture")],
        "_judged.*",
    )


def held_out(column: str = "doc_id") -> Column:
    """True for ids with CRC-32 remainder 2 of 4; false for the others and for a null id."""
    return F.coalesce(id_text(column) % 4 == 2, F.lit(False))


def train_on_rest(docs: DataFrame) -> Model:
    """Learn from the rows whose id is known and not held out."""
    return Model.train(docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a language; all columns stay as they are."""
    judged = identify(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("text").alias("_text")), model, "_text")
    return judged.where(F.col("lang_pred") != UNKNOWN).select("_row.*")
