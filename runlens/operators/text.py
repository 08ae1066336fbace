"""Character-level comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def characters(c: Column) -> Column:
    """Characters of a text; the empty text has none."""
    return F.filter(F.split(c, ""), lambda ch: ch != "")


def match_score(text: Column, target: str) -> Column:
    """How many characters equal the target's character at the same position.

    Characters beyond the target's end cannot match, so they are cut off first.
    """
    hits = F.zip_with(
        characters(F.substring(text, 1, len(target))),
        F.array(*[F.lit(ch) for ch in target]),
        lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"),
    )
    return F.aggregate(hits, F.lit(0), lambda acc, v: acc + v)


def positional_match(df: DataFrame, text: str, target: str, n: int | None = None) -> DataFrame:
    """Score of every row; with ``n`` the best rows only."""
    scored = df.withColumn("score", match_score(F.col(text), target))
    return scored if n is None else scored.orderBy(F.desc("score"), text).limit(n)


def alphabet_violations(df: DataFrame, text: str, alphabet: str) -> DataFrame:
    """Sorted distinct characters of a text that the alphabet lacks."""
    allowed = F.array(*[F.lit(ch) for ch in alphabet])
    return df.withColumn("violations", F.array_sort(F.array_except(characters(F.col(text)), allowed)))
