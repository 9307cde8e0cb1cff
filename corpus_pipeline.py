"""A training-data pipeline: from `documents` to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it
returns is written as Parquet and read again as the next one's docs. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, decontaminate, langid, near_dedup, secret_scan
from tessera.llm.tables import settled, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or no language
    that the model finds likelier than all others together. The model is
    fitted on the stage's own labelled documents."""
    return langid.identified(docs, langid.fit(docs))


def near_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id in each group of near-duplicates.

    Empty texts resemble nothing and stay; rows that share a doc_id are judged
    by their own texts, rows without one like others; of repeated rows one
    stays. An empty table stays empty.
    """
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark.

    Each row is judged by its own text, whatever its doc_id; null and empty
    texts and an empty benchmark drop nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mark, and bring n_chars up to date.

    Null texts stay null with their n_chars; all rows stay.
    """
    masked = secret_scan.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the token ids, and
    digests of them and of what they decode to.

    A null or empty text has no ids; null doc_ids and repeated rows pass.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe_codec.encode(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the language model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
