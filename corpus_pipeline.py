"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``:

1. language_id: documents without a letter, or whose language the network is too unsure of, go.
2. line_dedup: of each group of near-equal lines the first occurrence stays; texts and n_chars are updated.
3. near_dedup: of documents that a Jaccard similarity of 0.8 or more of their 5-word shingles connects, the one with the smallest
   doc_id stays.
4. mix: documents appear as often as the mixture of sources takes them (0 to 3 times).
5. byte_bpe: ids of every text, with digests of the ids and of the decoded bytes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fuzzy_lines, langid, mixing, near_docs, tokens
from tessera.llm.common import materialize

#: A text whose best language has a smaller probability than this is rejected.
LEAST_LANGUAGE_SCORE = 0.3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.fit(docs)
    pred, score = ("_" * (1 + max(map(len, docs.columns))) + x for x in ("pred", "score"))  # longer than any column's name
    judged = langid.predict(docs, net, keep=tuple(docs.columns), to=(pred, score))
    return judged.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_docs.deduplicated(docs, width=5, least=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("byte_bpe", byte_bpe)]

#: SQL can express neither the network nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
