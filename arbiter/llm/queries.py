"""One query per operator (``opN_<name>``) and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.llm import alignment as X12
from arbiter.llm import bpe as X2
from arbiter.llm import exact_dedup as X5
from arbiter.llm import minhash as X8
from arbiter.llm import fingerprints as X11
from arbiter.llm import licences as X10
from arbiter.llm import mixing as X6
from arbiter.llm import near_vectors as X1
from arbiter.llm import quality as X4
from arbiter.llm import repeats as X9
from arbiter.llm import sharding as X7
from arbiter.llm import token_counts as X3
from arbiter.llm import vector_codes as X13
from arbiter.llm.common import read_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return deco


# ---- 1: near-dedup of embeddings ---------------------------------------------------------------


@_query("op1_near_vectors")
def op1_near_vectors(spark, sf_dir):
    """Links of cosine 0.93 or more between vectors of a label; the least id of a component stays."""
    return X1.near_vectors(read_documents(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


# ---- 2, 3: tokenisers (not expressible in SQL; tested against the library) --------------------


@_query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark, sf_dir):
    """Ids and decoded text of every whole document, as digests."""
    return X2.round_trip(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@_query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    """Unigram token count and best score of every whole document."""
    return X3.token_counts(read_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


# ---- 4: quality classifier (tested against held-out labels) ------------------------------------


@_query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    """Weak votes, their posterior, the trained scorer's probability and the verdict of every document."""
    return X4.classify(read_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


# ---- 5: exact dedup ---------------------------------------------------------------------------

NORMALISED_SQL = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"


@_query(
    "op5_exact_dedup",
    sql=f"""WITH d AS (SELECT doc_id, sha256({NORMALISED_SQL}) AS s, {NORMALISED_SQL} AS t FROM documents),
      g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
      SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.s AS text_sha256
      FROM d JOIN g USING (t)""",
)
def op5_exact_dedup(spark, sf_dir):
    """Equal texts after white-space folding; the row with the least doc_id stays."""
    return X5.exact_dedup(read_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


# ---- 6: mixing (tested against a sequential scheduler) ------------------------------------------

#: Largest share of one source in the mix.
SOURCE_CAP = 0.25


@_query("op6_pfair_mix")
def op6_pfair_mix(spark, sf_dir):
    """Slot and position of every document in the mix; no source above a quarter."""
    docs = read_documents(spark, sf_dir)
    return X6.mix(docs, X6.capped_weights(docs, SOURCE_CAP)).withColumnRenamed("id", "doc_id")


# ---- 7: sharding (tested by its law and by brute force) -----------------------------------------


@_query("op7_balanced_shards")
def op7_balanced_shards(spark, sf_dir):
    """40 shards of even row counts; equal texts share a shard where its size allows."""
    d = X7.shard(read_documents(spark, sf_dir))
    return d.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "group_rows",
    )


# ---- 8: near-dedup of texts (tested against brute force) --------------------------------------


@_query("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark, sf_dir):
    """Components of documents whose 2-word shingle sets reach Jaccard 0.8."""
    return X8.near_dups(read_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


# ---- 9: repeated byte strings (tested against brute force) ------------------------------------


@_query("op9_repeated_strings")
def op9_repeated_strings(spark, sf_dir):
    """Bytes covered by a 100-byte string that also starts earlier are removed."""
    return X9.drop_repeats(read_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


# ---- 10: licence scan (tested against the planted lines) ----------------------------------------


@_query("op10_licence_scan")
def op10_licence_scan(spark, sf_dir):
    """Confirmed licence families of every document, with the paragraphs that state them."""
    return X10.licences(read_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


# ---- 11: fingerprints (tested against brute force) ----------------------------------------------


@_query("op11_document_fingerprints")
def op11_document_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how near they are."""
    return X11.fingerprints(read_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


# ---- 12: alignment of two tokenizers (tested against brute force) --------------------------------


@_query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    """Groups and links between the tokens of two tokenizers over every whole document."""
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return X12.align(read_documents(spark, sf_dir), *paths).withColumnRenamed("id", "doc_id")


# ---- 13: vector codes ---------------------------------------------------------------------------


@_query("op13_vector_codes", sql=X13.codes_sql())
def op13_vector_codes(spark, sf_dir):
    """8 codebooks of 16 entries fitted by 6 exact Lloyd rounds; code and error of every vector."""
    return X13.vector_codes(read_documents(spark, sf_dir, "embeddings"))
