"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, byte-level BPE.

Each stage takes the rows that the one before kept.  The first four return the
columns of the documents table; the last returns token counts and digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import bpe, decontaminate, near_dedup, pii, toxicity
from rainloom.session import cut_lineage


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model is fitted on labelled rows of these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, out="__score", keep=tuple(docs.columns))
    return scored.where("__score < 0.5").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least id, once; rows without id stay."""
    return near_dedup.first_of_each(docs, near_dedup.near_duplicates(docs, size=3, percent=85))


def contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, keep=tuple(docs.columns))
    return found.where("not contaminated").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    masked = pii.mask(docs, pii.fit(docs))
    return masked.withColumn("n_chars", F.coalesce(pii.n_chars(), "n_chars")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded bytes of every document."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_documents),
    ("minhash_dedup", near_duplicates),
    ("benchmark_decontamination", contaminated_documents),
    ("pii", personal_data),
    ("bpe", tokens),
]

#: Fitted models and a byte-pair encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
