"""The corpus pipeline: quality, exact copies, near copies, mix, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all of ``docs`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``. Documents leave by an anti-join against the ids that go: a written table, which
the planner broadcasts only when its size is small.

Defined results: null and empty texts pass the quality stage, count as one exact group, are near
nothing and have no tokens; rows that share a doc_id are documents of their own (of equal texts under
one id one stays); an empty table stays empty; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm import bpe, exact_dedup, minhash, mixing, quality
from arbiter.llm.common import row_keyed, staged

#: Words per shingle and least Jaccard similarity (percent) of near copies.
SHINGLE, SIMILAR = 5, 80
#: Largest share of one source in the mix.
SOURCE_CAP = 0.25


#: Rows of one batch on its way to a Python worker: bounds what a worker and its buffers hold of whole texts.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _without(docs: DataFrame, name: str, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` but those of which ``gone(rows)`` returns the ``id``.

    Where doc_ids repeat, ``gone`` sees rows whose doc_id is a key of the row, so a row leaves by itself.
    """
    keyed, key = row_keyed(docs, "doc_id", "text")
    rows = keyed if key == "doc_id" else keyed.drop("doc_id").withColumnRenamed(key, "doc_id")
    ids = staged(gone(rows).select(F.col("id").alias(key)), name)
    return keyed.join(ids, key, "left_anti").select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject."""
    _small_batches(spark)
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of every group of equal texts."""
    _small_batches(spark)
    return _without(docs, "copies", lambda d: exact_dedup.exact_dedup(d).where("NOT kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by word shingles."""
    _small_batches(spark)
    near = lambda d: minhash.near_dups(d, words=SHINGLE, percent=SIMILAR).where("NOT kept")
    return _without(docs, "near-copies", near)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stand in the mix at target weights, up to where a source runs out."""
    mix = lambda d: mixing.mix(d, mixing.capped_weights(d, SOURCE_CAP)).where("NOT in_mix")
    return _without(docs, "not-in-mix", mix)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the encoded and decoded text of what is left."""
    _small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Trained and hashed stages are not SQL; tests/llm hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
