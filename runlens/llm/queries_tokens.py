"""Queries of the token operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, token_counts, token_file
from .common import scratch, table
from .registry import query

LIMIT = 4096
END_ID = 2


@query("op1_byte_bpe")
def op1(spark, sf_dir):
    """Ids of every document and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return decoded.select("doc_id", *bpe.digests())


@query("op2_token_files")
def op2(spark, sf_dir):
    """Write the token files of all documents and read every document back."""
    path = token_file.write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "tokens"), END_ID
    )
    return token_file.read_crc(spark, path)


@query("op6_token_counts")
def op6(spark, sf_dir):
    """Bytes and tokens of every document."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
