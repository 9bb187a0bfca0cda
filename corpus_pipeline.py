"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes
each stage's documents as Parquet below spark.checkpoint.dir and reads them again for the next. All but
the last return the columns of ``documents``.

1. ``quality``: documents that the co-trained classifier finds of low quality or toxic go. It is fitted
   on ``labels`` of the documents it is given.
2. ``lines``: later copies of repeated line runs are deleted from the texts; ``n_chars`` follows.
3. ``near_duplicates``: of each class of near copies the document with the smallest doc_id stays.
4. ``decontamination``: documents that hold benchmark passages go.
5. ``tokens``: byte-level BPE ids of each text, with the digest of the bytes that they decode to.

Rows with a null doc_id are documents like others, and rows that share a doc_id are judged by their texts; of rows that
share both, stage 3 keeps one. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import byte_bpe, decontaminate, line_dedup, minhash, quality
from geolith.llm.common import read_table, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.filter_documents(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: A fitted classifier and a BPE encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
