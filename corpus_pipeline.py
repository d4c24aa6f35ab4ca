"""From documents to token ids: quality, near-duplicates, repeats, benchmark leaks, BPE.

Each stage takes (spark, docs, sf_dir) and works on what the one before it kept; all but
the last return the columns of ``documents``. Between stages the rows are written as
Parquet to the folder that the cluster shares and read again; what a stage wrote on the
way goes when it ends.

A null or empty text is scored, and goes or stays, by its statistics like any other; it
has no near-duplicates, repeats or leaks, and encodes to no tokens. A null doc_id has no
near-duplicates and counts as the largest one among repeats. Rows that repeat a doc_id go
through every stage as rows of their own; where a smaller id stands for a document, all its
rows go. Further columns of the table stay until the last stage; the operators'
own columns all begin with an underscore. Empty tables give empty ones; without labels
every document scores 0.5 and stays, and without benchmark none is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import encode_documents
from palimpsest.llm.common import discard, free_name, materialize, materialize_alone
from palimpsest.llm.decontam import decontaminate
from palimpsest.llm.neardup_texts import drop_near_duplicates
from palimpsest.llm.quality import THRESHOLD, score_quality
from palimpsest.llm.substrings import remove_repeated

#: Hundredths of similarity from which documents are near-duplicates here.
SIMILARITY = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    score = free_name("_quality", docs)
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into=score)
    return scored.filter(F.col(score) >= THRESHOLD).drop(score)


def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return drop_near_duplicates(docs, SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id holds."""
    return remove_repeated(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes that they decode to."""
    coded = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids_le")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_first_of_group),
    ("repeated_passages", cut_repeats),
    ("decontamination", keep_uncontaminated),
    ("encoding", encode),
]

#: No SQL can train the classifier or merge the tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage_{name}")
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
