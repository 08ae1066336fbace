"""Language identification with interpolated Kneser-Ney character models.

One model of character n-grams per language.  The models share sorted arrays of
n-gram hashes with one column of log probabilities for each language, so a text
position costs one binary search for all languages.  The language with the
lowest cross-entropy per character is chosen.  A text is rejected when that
cross-entropy lies above the limit calibrated for its language and length.

Texts are lower-cased; all that is not a letter counts as white space, and runs
of it as one space.  Whole texts are scored.  A text that is null or has no
letter is ``und`` with score 0, and rejected.

Fitting uses a bounded sample of labelled rows: for each language the
``max_docs`` rows that come first by a hash of their id, every ``CALIBRATE``-th
of them for calibration.  The model grows with the sample, not with the corpus.
Rows without a label or text, and empty tables, teach nothing; with no labelled
text at all every text is ``und``.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_slices

ORDER = 4
MAX_DOCS = 1_000
CALIBRATE = 5
#: Parts of a language that are ranked apart, so that no task ranks all rows of one.
PARTS = 64
#: A rejected text is so many standard errors of its length, and nats per character, above its language's mean.
ERRORS = 8.0
MARGIN = 1.0
#: Score: how sharply differences of cross-entropy (nats per character) tell.
SHARPNESS = 12.0
UNKNOWN = "und"
#: Bytes of text worked on at once; the arrays beside it take about a hundred times that.
SLICE = 1 << 18
SPACE = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point to itself where it is a letter, else to a space."""
    return np.fromiter((i if chr(i).isalpha() else SPACE for i in range(sys.maxunicode + 1)), np.uint32)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each text with ``ORDER - 1`` spaces before and one after, and where each begins."""
    pad = " " * (ORDER - 1)
    lowered = [f"{pad}\0{t.lower()} " for t in texts]
    raw = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    mark = raw == 0
    first = np.zeros(len(raw), bool)
    starts = np.cumsum([0, *(len(t) for t in lowered)])
    first[starts[:-1] + ORDER - 1] = True  # the mark before a text, whatever zeros it holds itself
    c = letters()[raw]
    blank = c == SPACE
    follows = np.empty(len(c), bool)
    follows[0] = False
    follows[1:] = blank[:-1]
    inside = np.ones(len(c), bool)
    for k in range(ORDER - 1):
        inside[starts[:-1] + k] = False
    keep = ~(blank & follows & inside) & ~(first & mark)
    places = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], places[starts]


def hashes(c: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place from n - 1 on."""
    h = c[: len(c) - n + 1].astype(np.uint64)
    for k in range(1, n):
        h = h * BASE + c[k : len(c) - n + 1 + k]
    h *= MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Model:
    languages: list[str]
    #: By n - 1: sorted hashes of the n-grams and their log probabilities by language.
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    #: By n - 1: sorted hashes of contexts of n - 1 characters and the log weight of what is below.
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def _levels(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) for n from 1 on; below the highest order a count is the number of different characters before."""
    levels = [(grams, counts.astype(float))]
    while grams.shape[1] > 1:
        grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)
        levels.insert(0, (grams, counts.astype(float)))
    return levels


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    if rows.shape[1] == 0:
        return np.zeros(len(rows), np.uint64)
    h = rows[:, 0].astype(np.uint64)
    for k in range(1, rows.shape[1]):
        h = h * BASE + rows[:, k]
    h *= MIX
    return h ^ (h >> np.uint64(29))


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
    return at, (keys[at] == h if len(keys) else np.zeros(len(h), bool))


def build(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models from each language's n-grams (rows of ORDER characters) and their counts."""
    languages = sorted(grams)
    levels = {x: _levels(*grams[x]) for x in languages}
    alphabet = len(np.unique(np.concatenate([levels[x][0][0][:, 0] for x in languages]))) + 1
    model = Model(languages, [], [], [], [], np.zeros(len(languages)), *(np.zeros(len(languages)) for _ in "ab"))
    below = np.zeros((0, len(languages)))
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([levels[x][n - 1][0] for x in languages]), axis=0)
        h = _hash_rows(union)
        order = np.argsort(h)
        union, h = union[order], h[order]
        context_of = _hash_rows(union[:, :-1])
        context_keys = np.unique(context_of)
        weight = np.ones((len(context_keys), len(languages)))
        own = np.zeros((len(h), len(languages)))
        for k, x in enumerate(languages):
            g, c = levels[x][n - 1]
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            at, _ = _find(context_keys, _hash_rows(g[:, :-1]))
            total = np.bincount(at, c, len(context_keys))
            kinds = np.bincount(at, minlength=len(context_keys))
            seen = total > 0
            weight[seen, k] = discount * kinds[seen] / total[seen]
            place, _ = _find(h, _hash_rows(g))
            own[place, k] = np.maximum(c - discount, 0) / total[at]
        if n == 1:
            lower = np.full((len(h), len(languages)), 1 / alphabet)
            model.floor = np.log(weight[0] / alphabet)
        else:
            at, _ = _find(model.keys[-1], _hash_rows(union[:, 1:]))
            lower = below[at]
        at, _ = _find(context_keys, context_of)
        below = own + weight[at] * lower
        model.keys.append(h)
        model.logs.append(np.log(below).astype(np.float32))
        model.contexts.append(context_keys)
        model.weights.append(np.log(weight).astype(np.float32))
    return model


def log_probabilities(model: Model, c: np.ndarray) -> np.ndarray:
    """Log probability of each character from place ORDER - 1 on, by language."""
    h = hashes(c, ORDER)
    at, hit = _find(model.keys[-1], h)
    out = model.logs[-1][at]
    todo = np.flatnonzero(~hit)
    if len(todo):
        total = np.zeros((len(todo), len(model.languages)), np.float32)
        rest = np.arange(len(todo))
        for n in range(ORDER, 0, -1):
            place = todo[rest]
            if n < ORDER:
                at, hit = _find(model.keys[n - 1], _hash_rows(c[place[:, None] + np.arange(ORDER - n, ORDER)]))
                total[rest[hit]] += model.logs[n - 1][at[hit]]
                rest, place = rest[~hit], place[~hit]
            if n > 1 and len(rest):
                at, hit = _find(model.contexts[n - 1], _hash_rows(c[place[:, None] + np.arange(ORDER - n, ORDER - 1)]))
                total[rest[hit]] += model.weights[n - 1][at[hit]]
        total[rest] += model.floor.astype(np.float32)
        out[todo] = total
    return out


def score_texts(model: Model, texts: list[str | None]):
    """(language number or -1, score, cross-entropy, spread of the character costs, characters) for each text."""
    n = len(texts)
    best, score, entropy, spread = np.full(n, -1), np.zeros(n), np.full(n, np.nan), np.zeros(n)
    size = np.zeros(n, np.int64)
    if not n or not model.languages:
        return best, score, entropy, spread, size
    c, starts = codes([t or "" for t in texts])
    if len(c) >= ORDER:
        logs = log_probabilities(model, c)
        has = np.add.reduceat(c != SPACE, starts[:-1]) > 0
        # the first ORDER - 1 places of a text are its padding
        size = np.diff(starts) - (ORDER - 1)
        lows = starts[:-1]
        valid = np.flatnonzero(has & (size > 0))
        if len(valid):
            # place i of logs is the character at i + ORDER - 1, so a text's own begin at its start
            edges = np.stack([lows[valid], lows[valid] + size[valid]], 1).ravel()
            padded = np.concatenate([logs, np.zeros((ORDER, logs.shape[1]), np.float32)])
            sums = np.add.reduceat(padded, edges, axis=0)[::2].astype(float)
            cost = -sums / size[valid, None]
            pick = cost.argmin(1)
            lowest = cost[np.arange(len(valid)), pick]
            best[valid] = pick
            entropy[valid] = lowest
            score[valid] = 1 / np.exp(-SHARPNESS * (cost - lowest[:, None])).sum(1)
            for i, k in zip(valid, pick):
                spread[i] = padded[lows[i] : lows[i] + size[i], k].std()
    return best, score, entropy, spread, size


def _count_grams(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    def run(batches):
        for batch in (part for whole in batches for part in byte_slices(whole, "text", SLICE)):
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = batch.column("text").to_pylist()
            for lang in set(langs):
                c, starts = codes([t for t, x in zip(texts, langs) if x == lang])
                h = hashes(c, ORDER)
                # a window that reaches into the next text's padding isn't a gram of either
                inside = np.ones(len(h), bool)
                for s in starts[1:-1]:
                    inside[s - ORDER + 1 : s] = False
                places = np.flatnonzero(inside)
                _, first, counts = np.unique(h[places], return_index=True, return_counts=True)
                rows = c[places[first][:, None] + np.arange(ORDER)]
                text = ["".join(map(chr, r)) for r in rows.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(text)), pa.array(text, pa.string()), pa.array(counts.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    counted = docs.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()  # bounded by the sample
    out = {}
    for lang, part in rows.groupby("lang"):
        matrix = np.array([[ord(x) for x in g] for g in part["gram"]], np.uint32)
        out[lang] = (matrix, part["n"].to_numpy())
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_docs: int = MAX_DOCS) -> Model:
    """Fit on a bounded sample of labelled rows: ``max_docs`` of each language."""
    rows = labelled.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("lang"), F.col(text_col).alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("id", "lang").distinct().withColumn("hash", F.xxhash64("id"))
    # first the smallest of each part of a language, then of those the smallest of the language
    part = Window.partitionBy("lang", F.pmod("hash", F.lit(PARTS))).orderBy("hash", "id")
    some = ids.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= max_docs)
    chosen = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))).where(
        F.col("rank") <= max_docs
    ).drop("hash")
    # at most max_docs ids of each language
    sample = rows.join(F.broadcast(chosen), ["id", "lang"]).persist()
    grams = _count_grams(sample.where(F.col("rank") % CALIBRATE != 0))
    if not grams:
        sample.unpersist()
        return Model([], [], [], [], [], *(np.zeros(0) for _ in "abc"))
    model = build(grams)
    held = sample.where(F.col("rank") % CALIBRATE == 0)

    def run(batches):
        for batch in (part for whole in batches for part in byte_slices(whole, "text", SLICE)):
            best, _, entropy, spread, _ = score_texts(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.astype(np.int32)), pa.array(entropy), pa.array(spread)], ["k", "entropy", "spread"]
            )

    stats = (
        held.mapInArrow(run, "k int, entropy double, spread double")
        .where("k >= 0")
        .groupBy("k")
        .agg(F.avg("entropy").alias("mean"), F.avg("spread").alias("spread"))
        .collect()
    )
    sample.unpersist()
    known = {r.k: r for r in stats}
    for k in range(len(model.languages)):
        # a language without rows to calibrate with rejects nothing
        model.mean[k] = known[k].mean if k in known else np.inf
        model.spread[k] = known[k].spread if k in known else 0.0
    return model


def judged(model: Model, texts: list[str | None]):
    """(language number or -1, score, cross-entropy, rejected) for each text."""
    best, score, entropy, _, size = score_texts(model, texts)
    limit = np.full(len(best), -np.inf)
    ok = best >= 0
    if ok.any():
        limit[ok] = model.mean[best[ok]] + MARGIN + ERRORS * model.spread[best[ok]] / np.sqrt(np.maximum(size[ok], 1))
    return best, score, entropy, ~ok | (np.nan_to_num(entropy, nan=np.inf) > limit)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, text_col, SLICE):
                rejected = judged(shared.value, batch.column(text_col).to_pylist())[3]
                yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, entropy, rejected), one row for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*model.languages, UNKNOWN]

    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                best, score, entropy, rejected = judged(model, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([names[k] for k in best], pa.string()),
                        pa.array(np.clip(score, 0.0, 1.0)),
                        pa.array(entropy, mask=np.isnan(entropy)),
                        pa.array(rejected),
                    ],
                    ["id", "lang_pred", "score", "entropy", "rejected"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, lang_pred string, score double, entropy double, rejected boolean"
    ).withColumnRenamed("id", id_col)
