"""Cross-site boilerplate lines by the spread of distinct sites.

Every line has a HyperLogLog sketch of the sites that hold it, built in the map
tasks and merged by aggregation.  Lines whose estimate is clearly below or above
``min_sites`` are decided; those within the sketch's error of it are counted
exactly.  Lines of ``min_sites`` or more are boilerplate and removed, so a third
of all rows with one line costs one sketch from each task.

Boilerplate goes whatever its share of a document.  Only a document without any
other line stays whole: that is a copy spread over sites, for the stages that work on
documents.  ``max_share`` keeps those whole as well of which boilerplate makes up
more than that share of the characters.

Lines end at U+000A and are compared without spaces at their ends; blank ones
are never removed.  A null text stays null, a null site counts as no site, and
rows with the same id are handled one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joinable, saved

MIN_SITES = 10
LG_K = 12
#: Standard errors of the sketch within which a line is counted exactly.
ERRORS = 4


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, key, site, pos, h, n): a row for each line that isn't blank; (h, n) stands for its content."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("key"),
        F.col(site_col).alias("site"),
        F.posexplode(lines(F.col(text_col))).alias("pos", "line"),
    )
    return rows.withColumn("line", F.trim("line")).where("line <> ''").select(
        "id", "key", "site", "pos", F.xxhash64("line").alias("h"), F.char_length("line").alias("n")
    )


def boilerplate(occurrences: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, n) of the lines that ``min_sites`` or more distinct sites hold."""
    spread = occurrences.groupBy("h", "n").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    error = ERRORS * 1.04 / 2 ** (LG_K / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    estimated = saved(
        spread.select("h", "n", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low), "spread"
    )
    near = saved(estimated.where(F.col("sites") <= high).select("h", "n"), "near")
    exact = (
        occurrences.join(joinable(near, 16), ["h", "n"])
        .where(F.col("site").isNotNull())
        .select("h", "n", "site")
        .distinct()
        .groupBy("h", "n")
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return saved(estimated.where(F.col("sites") > high).select("h", "n").unionByName(exact.select("h", "n")), "boilerplate")


def remove_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    max_share: float | None = None,
) -> DataFrame:
    """``docs`` with cleaned texts, and the columns ``boilerplate_lines`` and ``removed_lines``."""
    found = _occurrences(docs, id_col, text_col, site_col)
    common = boilerplate(found, min_sites)
    flagged = saved(
        found.select("id", "key", "pos", "h", "n")
        .join(joinable(common, 16), ["h", "n"])
        # rows with one id and text have the same lines
        .groupBy("id", "key", "pos")
        .agg(F.max("n").alias("n"))
        .groupBy("id", "key")
        .agg(F.collect_list("pos").alias("places"), F.sum("n").alias("size")),
        "flagged",
    )
    part = lambda x, i: F.when(~F.array_contains("__places", i), x)
    kept = F.array_join(F.filter(F.transform(lines(F.col(text_col)), part), lambda x: x.isNotNull()), "\n")
    if max_share is None:
        own = F.size(F.filter(lines(F.col(text_col)), lambda x: F.trim(x) != "")) > F.size("__places")
    else:
        own = F.col("__size") <= max_share * F.char_length(text_col)
    clean = F.col("__places").isNotNull() & own
    # as many rows as documents with boilerplate: they grow with the input, so they are never broadcast
    marks = flagged.select(
        F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("places").alias("__places"), F.col("size").alias("__size")
    ).hint("merge")
    return (
        docs.withColumn("__own", F.xxhash64(text_col))
        .join(marks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
        .withColumn("boilerplate_lines", F.coalesce(F.size("__places"), F.lit(0)).cast("long"))
        .withColumn("removed_lines", F.when(clean, F.col("boilerplate_lines")).otherwise(F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(clean, kept).otherwise(F.col(text_col)))
        .drop("__own", "__id", "__key", "__places", "__size")
    )
