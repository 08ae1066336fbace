"""Queries of language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language_id
from .common import table
from .registry import query

#: Rows whose id has this remainder are held out.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT


@query("op9_language_id")
def op9(spark, sf_dir):
    """The language of every document, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    found = language_id.identify(docs, model)
    return found.withColumn("held_out", held_out()).select(
        "doc_id", "held_out", "lang_pred", "score", "entropy", "rejected"
    )
