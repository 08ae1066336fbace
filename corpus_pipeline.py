"""The corpus pipeline: stages over the documents table, each over what the stage before kept.

1. Language identification: documents without a language, or far from the one
   they are closest to, go.  The model is learnt from the stage's own labelled rows.
2. Line deduplication: boilerplate lines that many sites share are cut out,
   whatever their share of a document; one that has no other line stays whole.
3. N-gram Jaccard join: of every component of near duplicates the document with
   the least id stays.
4. Benchmark decontamination: documents that hold a benchmark item go.
5. Byte-level BPE: the ids of what is left, and the digest of the bytes they decode to.

Rows are written as Parquet after each stage and read again.  SQL can't express the
first stage, so there is no ``ORACLE_SQL``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import bpe, decontaminate, language_id, line_dedup, ngram_jaccard
from runlens.llm.common import saved, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have."""
    return language_id.accepted(docs, language_id.fit(docs))


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share; ``n_chars`` follows the text."""
    cleaned = line_dedup.remove_boilerplate(docs)
    changed = F.col("removed_lines") > 0
    return cleaned.withColumn(
        "n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: five words to a shingle, similarity 0.8."""
    return ngram_jaccard.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids of the documents, and the digest of the bytes that the ids stand for."""
    ranks = public_tokenizers.path(RANKS)
    decoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language", language),
    ("boilerplate", boilerplate),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    name, last = STAGES[-1]
    return last(spark, docs, sf_dir)
