"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and the units after
numbers are typed placeholders.  Windows of ``WINDOW`` tokens are hashed and
joined with the windows of the benchmark items, so a question whose values were
changed still matches.  The matches of an item are told apart by their offset: how
far the item is shifted to lie on the document.  A document holds an item when at
one offset at least ``MATCHED`` windows in a row (or all, if it has fewer) match:
thirteen tokens in a row for the defaults.  Windows without a word, as in a table of
numbers, match only with the same values.  The values of placeholders in the matched windows of an offset are lined
up: a value of the item must always stand for the same value in the document, or
the offset doesn't count.  Other offsets have no say in it.

A name is a run of capitalised words after a lower-case letter, a comma, a colon
or a semicolon and a space; the first word of a sentence can't be told from one
and stays a word.  The start of an item may follow either in a document, so it is
looked for in both forms.  Items with fewer than ``WINDOW`` tokens are one window of their
own length.  Nulls and texts without tokens hold nothing and are held by nothing.
Rows with the same id are judged one by one; the id holds what one of them holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joinable, saved

WINDOW = 8
MATCHED = 6
#: What makes the start of an item one of the places where names are seen.
INSIDE = ", "
#: Units that may follow a number.
UNITS = "kg g mg lb lbs oz km m cm mm mi ft in l ml s ms min h hours days weeks years percent % usd eur dollars euros".split()

NAME, NUMBER, UNIT, END = "\x01", "\x02", "\x03", "\x04"
NAMES = r"([\p{Ll},;:] )\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*"
NUMBERS = r"\p{N}+(?:[.,]\p{N}+)*"
UNIT_WORDS = "|".join(sorted(UNITS, key=len, reverse=True))
UNIT_AFTER = rf"{NUMBER} ?(?:{UNIT_WORDS})($|[^\p{{L}}\p{{N}}])"
TOKEN = r"([\p{L}]+|[\x01-\x03])"
#: The same with the values kept behind their placeholders, up to ``END``.
VALUED_NAMES = r"([\p{Ll},;:] )(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*)"
VALUED_UNIT = rf"({NUMBER}[^{END}]*{END}) ?(?:{UNIT_WORDS})($|[^\p{{L}}\p{{N}}])"
VALUED_TOKEN = r"([\x01\x02][^\x04]*\x04|[\p{L}]+|\x03)"


def _flat(pattern: str) -> str:
    """The same for Java, whose stack grows with each repeat of a group unless repeats are never given back; nothing here asks for them."""
    return pattern.replace(")*", ")*+")


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01-\x03]", " "), END, "\x05")


def canonical(text: Column) -> Column:
    """Tokens of a text, with placeholders."""
    named = F.regexp_replace(_plain(text), _flat(NAMES), f"$1{NAME}")
    counted = F.regexp_replace(named, _flat(NUMBERS), NUMBER)
    measured = F.regexp_replace(counted, UNIT_AFTER, f"{NUMBER}{UNIT}$1")
    return F.regexp_extract_all(F.lower(measured), F.lit(TOKEN), F.lit(1))


def valued(text: Column) -> Column:
    """The tokens of ``canonical``, where names and numbers have their values behind them."""
    named = F.regexp_replace(_plain(text), _flat(VALUED_NAMES), f"$1{NAME}$2{END}")
    counted = F.regexp_replace(named, _flat(NUMBERS), f"{NUMBER}$0{END}")
    measured = F.regexp_replace(counted, VALUED_UNIT, f"$1{UNIT}$2")
    return F.regexp_extract_all(F.lower(measured), F.lit(VALUED_TOKEN), F.lit(1))


def windows(tokens: str, length: int, text: Column) -> Column:
    """Hashes of all windows of ``length`` tokens of an array column; windows without a word are hashed with their values."""
    last = F.size(tokens) - length
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    cut = lambda array, i: F.slice(array, i + 1, length)
    wordless = lambda i: F.forall(cut(F.col(tokens), i), lambda t: t.isin(NAME, NUMBER, UNIT))
    bare = F.transform(at, lambda i: F.xxhash64(cut(F.col(tokens), i)))
    # few texts have such windows
    full = F.zip_with(bare, _value_hashes(valued(text), at, length), lambda h, v: F.struct(h.alias("h"), v.alias("v")))
    mixed = F.transform(full, lambda x, i: F.when(wordless(i), x["v"]).otherwise(x["h"]))
    some = F.array_join(F.col(tokens), " ").rlike(rf"(?:[\x01-\x03] ){{{length - 1}}}[\x01-\x03]")
    return F.when(some, mixed).otherwise(bare)


def _value_hashes(tokens: Column, at: Column, length: int) -> Column:
    """Hashes of the windows at the places ``at``, seeded apart from those of ``windows``."""
    one = F.array(tokens)  # evaluated once, not for each window
    return F.flatten(F.transform(one, lambda t: F.transform(at, lambda i: F.xxhash64(F.slice(t, i + 1, length), F.lit("values")))))


def _placed(hashes: Column, length: int) -> Column:
    return F.transform(
        hashes, lambda h, i: F.struct(F.lit(length).alias("length"), i.alias("place"), h.alias("hash"))
    )


def slots(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, slot place, value) of the name and number placeholders of (keys, text)."""
    return (
        rows.select(*keys, F.posexplode(valued(F.col("text"))).alias("place", "token"))
        .where(F.col("token").startswith(NAME) | F.col("token").startswith(NUMBER))
        .select(*keys, "place", F.expr("substring(token, 2, length(token) - 2)").alias("value"))
    )


def _runs(places: Column) -> Column:
    """(low, high) of the runs of consecutive numbers of a sorted array."""
    low = F.transform(places, lambda p, i: F.when((i == 0) | (F.get(places, i - 1) < p - 1), p))
    high = F.transform(places, lambda p, i: F.when((i == F.size(places) - 1) | (F.get(places, i + 1) > p + 1), p))
    return F.arrays_zip(
        F.filter(low, lambda x: x.isNotNull()).alias("low"), F.filter(high, lambda x: x.isNotNull()).alias("high")
    )


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    matched: int = MATCHED,
) -> DataFrame:
    """(id_col, item_col, n_windows, item_windows, n_slots, n_changed), one row for each document and item it holds.

    The counts are those of the places of the document that hold the item.
    """
    alone = F.coalesce(F.col(text_col), F.lit(""))
    forms = benchmark.select(
        F.col(item_col).alias("item"), F.posexplode(F.array(alone, F.concat(F.lit(INSIDE), alone))).alias("form", "text")
    ).withColumn("tokens", canonical(F.col("text")))
    # the second form only where it differs
    items = saved(
        forms.where(F.size("tokens") > 0)
        .groupBy("item", "tokens")
        .agg(F.min_by("text", "form").alias("text"), F.min("form").alias("form")),
        "items",
    )
    lengths = sorted(r[0] for r in items.select(F.least(F.size("tokens"), F.lit(window))).distinct().collect())
    lengths = lengths or [window]
    of_item = None
    for n in lengths:  # at most ``window`` different ones
        own = items.where(F.least(F.size("tokens"), F.lit(window)) == n)
        part = own.select("item", "form", F.lit(n).alias("length"), F.posexplode(windows("tokens", n, F.col("text"))).alias("item_place", "hash"))
        of_item = part if of_item is None else of_item.unionByName(part)
    of_item = saved(of_item, "windows")
    sizes = of_item.groupBy("item", "form").agg(F.count(F.lit(1)).alias("item_windows"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).withColumn(
        "tokens", canonical(F.col("text"))
    )
    all_windows = F.flatten(F.array(*(_placed(windows("tokens", n, F.col("text")), n) for n in lengths)))
    hits = (
        rows.select("id", "key", F.explode(all_windows).alias("w"))
        .select("id", "key", "w.length", "w.place", "w.hash")
        .join(joinable(of_item, 40), ["length", "hash"])
        .groupBy("id", "key", "item", "form", "length", (F.col("place") - F.col("item_place")).alias("offset"))
        .agg(F.sort_array(F.collect_set("item_place")).alias("places"))
        .withColumn("n_windows", F.size("places"))
        .withColumn("runs", _runs(F.col("places")))
        .drop("places")
        .withColumn("longest", F.array_max(F.transform("runs", lambda r: r["high"] - r["low"] + 1)))
        .join(joinable(saved(sizes, "sizes"), 28), ["item", "form"])
        .where(F.col("longest") >= F.least(F.lit(matched), F.col("item_windows")))
    )
    enough = saved(hits, "runs")
    # values of the placeholders inside the matched windows, lined up
    offset = ["id", "key", "item", "form", "offset"]
    item_slots = saved(slots(items, "item", "form"), "item-slots")
    inside = lambda r: (F.col("place") >= r["low"]) & (F.col("place") < r["high"] + F.col("length"))
    wanted = enough.join(joinable(item_slots, 64), ["item", "form"]).where(F.exists("runs", inside)).select(
        *offset, (F.col("place") + F.col("offset")).alias("place"), F.col("value").alias("item_value")
    )
    wanted = saved(wanted, "wanted")
    ids = saved(wanted.select("id").distinct(), "ids")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(joinable(ids, 16), "id", "left_semi")
    texts = texts.withColumn("key", F.xxhash64("text")).dropDuplicates(["id", "key"])
    doc_slots = slots(texts, "id", "key")
    pairs = wanted.join(doc_slots, ["id", "key", "place"]).groupBy(*offset, "item_value").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )
    checked = pairs.groupBy(*offset).agg(
        F.sum("n").alias("n_slots"),
        F.sum(F.when(F.col("least") != F.col("item_value"), F.col("n")).otherwise(0)).alias("n_changed"),
        F.max(F.col("least") != F.col("most")).alias("mixed"),
    )
    return (
        enough.join(checked, offset, "left")
        .where(~F.coalesce("mixed", F.lit(False)))
        .groupBy("id", "item", "form")
        .agg(
            F.sum("n_windows").alias("n_windows"),
            F.first("item_windows").alias("item_windows"),
            F.coalesce(F.sum("n_slots"), F.lit(0)).cast("long").alias("n_slots"),
            F.coalesce(F.sum("n_changed"), F.lit(0)).cast("long").alias("n_changed"),
        )
        # the item as it is, if it matches so
        .groupBy("id", "item")
        .agg(F.min_by(F.struct("n_windows", "item_windows", "n_slots", "n_changed"), "form").alias("best"))
        .select("id", "item", "best.*")
        .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "item_windows", "n_slots", "n_changed")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    held = saved(find_items(docs, benchmark, id_col=id_col).select(id_col).distinct(), "held")
    return docs.join(joinable(held, 16), id_col, "left_anti").select(docs.columns)
