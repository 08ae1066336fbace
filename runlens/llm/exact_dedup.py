"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters.  The
distinct blocks are sorted and numbered; then neighbouring numbers of a text are
paired, the distinct pairs numbered, and so on, until one number is left.  Two
texts of the same length have the same last number exactly if they are equal:
numbers stand for contents, no hash decides.

Hashes only keep work away: a text that shares its length and 64-bit hash with
no other can't have an equal, so it has an identity of its own and needs no
blocks.  Blocks and pairs are made distinct before their shuffle, so a block that
a third of all texts hold is one row from each task there; the join that gives
texts their numbers is one that Spark splits at hot keys.

Nulls count as empty texts, which are equal to each other.  Rows with the same
id and text are separate rows; one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, joinable, saved

BLOCK = 2_048


def normalised(text_col: str = "text"):
    """The text with every run of blanks as one space."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{BLANK}+", " ")


def _numbered(distinct: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Sorted rows with a number each; written, so that the numbers stay what they are."""
    return saved(distinct.sortWithinPartitions(*columns).withColumn("number", F.monotonically_increasing_id()), name)


def name_texts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, n, identity) for rows (row, n, text) where n is the length of the text."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1))
    part = F.transform(at, lambda i: F.substring(F.col("text"), i * block + 1, F.lit(block)))
    blocks = rows.select("row", "n", F.posexplode(part).alias("pos", "block"))
    numbers = _numbered(blocks.select("block").distinct(), ["block"], "blocks")
    level = saved(blocks.join(numbers, "block").select("row", "n", "pos", "number"), "level")
    width, done = block, []
    while True:
        whole = F.col("n") <= width
        done.append(level.where(whole).select("row", "n", F.col("number").alias("identity")))
        rest = level.where(~whole)
        if rest.isEmpty():
            break
        pairs = rest.groupBy("row", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("number"))).alias("left"),
            # -1: no right neighbour
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("number"))), F.lit(-1)).alias("right"),
        )
        numbers = _numbered(pairs.select("left", "right").distinct(), ["left", "right"], "pairs")
        level = saved(pairs.join(numbers, ["left", "right"]).select("row", "n", "pos", "number"), "level")
        width *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``."""
    text = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("text")).select(
        "id", "text", F.char_length("text").alias("n"), F.xxhash64("text").alias("h")
    )
    facts = saved(text.select("id", "n", "h", F.sha2(F.col("text"), 256).alias("sha")), "facts")
    twins = saved(facts.groupBy("n", "h").count().where("count > 1").select("n", "h"), "twins")
    shared = joinable(twins, 16)
    single = facts.join(shared, ["n", "h"], "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    rows = saved(
        text.join(shared, ["n", "h"], "left_semi").select(
            F.monotonically_increasing_id().alias("row"), "id", "n", "text"
        ),
        "candidates",
    )
    named = saved(
        rows.select("row", "id", F.sha2(F.col("text"), 256).alias("sha")).join(name_texts(rows, block), "row"), "named"
    )
    groups = saved(
        named.groupBy("n", "identity").agg(
            F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size")
        ),
        "groups",
    )
    grouped = named.join(joinable(groups, 40), ["n", "identity"]).select(
        "id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
        "sha",
    )
    return single.unionByName(grouped).withColumnsRenamed({"id": id_col, "sha": "text_sha256"})
