"""From raw documents to token ids: five stages, each written as Parquet and reread.

``run(spark, sf_dir)`` applies them to ``documents`` and returns the last stage's
rows. No SQL expresses the language model, the fingerprints or the encoding, so
``ORACLE_SQL`` is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, language_id, piece_codec, simhash
from tidemark.llm.queries import MODEL_FILE
from tidemark.llm.shared import documents, written


# Arrow batches are counted in rows; whole documents are long, so a batch has few.
BATCH_ROWS = 1000


def _bounded(spark: SparkSession) -> None:
    """Keep what a batch of documents takes in the JVM and in Python small."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which no language is found (no text or no letter)."""
    _bounded(spark)
    return language_id.keep_identified(docs, language_id.train_on_rest(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id."""
    _bounded(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints keep the document with the smallest id."""
    _bounded(spark)
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold four fifths of a benchmark item's shingles."""
    _bounded(spark)
    return decontaminate.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids, with the end id, and the text they decode to."""
    _bounded(spark)
    return piece_codec.encode_decode(docs, piece_codec.read_model(piece_codec.model_path(MODEL_FILE)))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
