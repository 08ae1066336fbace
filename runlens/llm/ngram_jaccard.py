"""Jaccard join of word n-gram sets by universe partition and pigeonhole.

Two sets whose Jaccard similarity reaches ``share`` differ in at most H elements, H
following from their sizes.  Sets are put into bands of size.  For each band the
universe of shingles is hashed into ``H + 1`` segments, so two similar sets agree
in one segment at least; a set also takes part in the band below if partners of
it can lie there.  A set is indexed by the content of its segments.

Empty segments agree everywhere and say nothing, so nothing is indexed there.
What that loses is allocated elsewhere: a set with h empty segments is also
indexed by the one-deletion neighbourhoods of its first segments, as many of them
as hold h segments of two elements or more.  If all agreeing segments of a pair
are empty, one of those differs by one element only, so the pair meets there.
The few sets that don't have h such segments are compared with all sets that
share an empty segment with them.  Every similar pair is thus a candidate.

Contents of few elements are shared by texts that have only a passage in common.
Once links by the first cut are known, the groups that still join components are
counted, and each band is allocated the cheapest of three cuts: the first one; half
as many segments, each indexed by its content and its whole one-deletion
neighbourhood, as H elements can't change all of ``(H + 1) / 2`` segments by two;
or ``H + 2`` segments, of which two agree, indexed by subsets of two.  A finer cut
is made where its rows are fewer than the pairs of the open groups, for the sets
in those, and kept where it leaves fewer pairs.  A set with a segment too poor for
a finer cut keeps its first signatures beside it; two sets only miss each other
there if both are poor.

Candidates aren't all verified.  Before texts are dealt out by pairs, sketches of a
bit or two for each element are: their parities bound the difference from below, so
they never drop a similar pair, and few dissimilar pairs pass.  In a group of sets with one content, each set
proposes the one before it; every set verifies the proposal it got most often.
Verified links and equal sets give components.  A group whose members are all in
one component has nothing more to tell.  In the others each set again proposes
the one before it, in a new order each turn, if it is of another component and
a filter that bounds the difference by parity bits lets it pass; that filter never
drops a similar pair.  Once few of a turn's proposals are links, all pairs between different
components that pass are verified.  Such a pair mostly shares many groups; it is
left out in a group if both sets have an earlier one in common among their
``EARLIEST`` first, so it comes up once or twice, and in its first group always.
A component thus holds exactly the sets that
links connect, and a group that links hold together never emits all its pairs.

Words are runs of anything but U+0020 and U+0009 to U+000D, A-Z lower-cased.  A
text with fewer words than ``size`` has one shingle, its whole sequence; a text
without words, or null, has none and links with nothing.  Rows with the same id
count as one document, which links if any of its texts does; its pairs aren't
filtered if the texts differ.  Ids must be integers, a null id links with nothing.
Shingles are 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_slices, joinable, release, saved

SIZE = 5
SHARE = (80, 100)
RATIO = 1.5
#: Longs of parity bits for each set.
PARITY = 8
#: The fewest bits of a sketch.
SKETCH = 64
#: First groups of a set that tell whether a pair has met before.
EARLIEST = 12
#: Bytes of text worked on at once; the arrays beside it take about sixty times that.
SLICE = 1 << 19
#: Another turn of proposals follows if this share of the last ones were links.
WORTH = 0.25
#: Edges that one task follows alone (2 MB of ids); more are dealt out by node.
FEW_EDGES = 1 << 17

#: Bits of a signature that tell its band.
BAND_BITS = 6
_BAND = np.uint64((1 << BAND_BITS) - 1)

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; n is a power of two."""
    both = []
    for base in (_P, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [b" " if not t else t.encode() for t in texts]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    # one size for all usual slices; a longer text has its own, for as long as no other comes
    power, inverse = _powers(1 << max(20, int(len(b)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])])
    word = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, begins)  # first word of each text
    grams = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        grams = grams * _P + word[k : k + len(grams)]
    grams = mix(grams)
    sets = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist()):
        if high - low >= size:
            sets.append(np.unique(grams[low : high - size + 1]))
        elif high > low:
            whole = np.uint64(high - low)
            with np.errstate(over="ignore"):
                for w in word[low:high]:
                    whole = whole * _P + w
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


@dataclass(frozen=True)
class Bands:
    """Sizes and segments: the least size of each band, and its number of segments."""

    num: int
    den: int

    @property
    def ratio(self) -> float:
        return max(RATIO, self.den / self.num)

    def lows(self, most: int) -> list[int]:
        return _lows(self.ratio, 1 << int(most).bit_length())

    def segments(self, low: int, after: int) -> int:
        """For sizes from ``low`` to ``after - 1`` and partners of them: one more than elements may differ."""
        high = after - 1
        return (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num) + 1


@lru_cache(maxsize=8)
def _lows(ratio: float, most: int) -> list[int]:
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * ratio))))
    return lows


def _cut(values: np.ndarray, band: int, m: int, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The set cut into m segments: elements, their segments, sums and counts by segment, and the segments' numbers."""
    salt = np.uint64(((band + 1) * int(_INVERSE) + way * int(_P)) & 0xFFFFFFFFFFFFFFFF)
    element = mix(values + salt)
    segment = (element >> np.uint64(33)).astype(np.int64) % m
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, segment, element)
    return element, segment, sums, np.bincount(segment, minlength=m), np.arange(m, dtype=np.uint64) * _P + salt


def _alike(values: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, kinds) for H + 1 segments, of which one agrees."""
    element, segment, sums, held, number = _cut(values, band, m, 0)
    full = held > 0
    out, kinds = [mix(sums[full] ^ mix(number[full]))], [np.zeros(int(full.sum()), np.int8)]
    empty = int(m - full.sum())
    if empty:
        rich = np.flatnonzero(held >= 2)
        enough = len(rich) >= empty
        upto = int(rich[empty - 1]) + 1 if enough else m
        lone = (segment < upto) & (held[segment] >= 2)
        less = sums[segment[lone]] - element[lone]
        out += [mix(less ^ mix(number[segment[lone]])), mix(number[~full] + np.uint64(1))]
        kinds += [np.zeros(int(lone.sum()), np.int8), np.full(empty, 1 if enough else 2, np.int8)]
    return np.concatenate(out), np.concatenate(kinds)


def _near(values: np.ndarray, band: int, m: int) -> tuple[np.ndarray, bool]:
    """Signatures for (H + 1) / 2 segments, of which one differs by an element at most; whether all hold two elements."""
    element, segment, sums, held, number = _cut(values, band, m, 1)
    full, lone = held > 0, held[segment] >= 2
    less = sums[segment[lone]] - element[lone]
    return np.concatenate([mix(sums[full] ^ mix(number[full])), mix(less ^ mix(number[segment[lone]]))]), bool((held >= 2).all())


def _twice(values: np.ndarray, band: int, m: int) -> tuple[np.ndarray, bool]:
    """Signatures for H + 2 segments, of which two agree; whether all hold an element."""
    _, _, sums, held, number = _cut(values, band, m, 2)
    full = held > 0
    content = mix(sums[full] ^ mix(number[full]))
    i, j = np.triu_indices(len(content), 1)
    return mix(content[i] * _P + content[j]), bool(full.all())


def signatures(values: np.ndarray, bands: Bands, ways: dict[int, str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, kinds) of a set: 0 contents, 1 empty segments, 2 those of a set that must be compared there.

    The last ``BAND_BITS`` bits of a signature are its band.  ``ways`` names bands that
    are cut in another way, and the others are then left out.
    """
    n = len(values)
    lows = bands.lows(n)
    own = int(np.searchsorted(lows, n, side="right")) - 1
    schemes = [own]
    if own and -(-bands.num * n // bands.den) < lows[own]:
        schemes.append(own - 1)
    out, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
    for band in schemes:
        m = bands.segments(lows[band], lows[band + 1])
        if ways is not None:
            if band not in ways:
                continue
            found, whole = _near(values, band, near_segments(m)) if ways[band] == "near" else _twice(values, band, m + 1)
            parts = [(found, np.zeros(len(found), np.int8))]
            if not whole:  # what agrees with it may be empty, if the other set isn't whole either
                parts.append(_alike(values, band, m))
        else:
            parts = [_alike(values, band, m)]
        for found, kind in parts:
            out.append((found & ~_BAND) | np.uint64(band))
            kinds.append(kind)
    return np.concatenate(out), np.concatenate(kinds)


def near_segments(m: int) -> int:
    """Segments that H = m - 1 elements can't all change by two."""
    return (m + 1) // 2


def sketches(hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bits of sets of ``n`` elements, whose hashes follow one another: the least power of two from ``n`` on of each."""
    width = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])
    own = (np.repeat(width, n) - 1).astype(np.uint64)
    at = np.repeat(ends[:-1], n) + (hashes & own).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(bits)])


def least_difference(x: bytes, y: bytes) -> int:
    """So many elements at least are in one of two sets alone, by their sketches; the longer one is folded."""
    u, v = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(v) > len(u):
        v = v[: len(v) // 2] ^ v[len(v) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _facts(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, f1, f2, p0 .., sketch): size, fingerprint and parity bits of each set."""

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text").to_pylist(), size)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                row = np.repeat(np.arange(len(sets)), n)
                prints = np.zeros((2, len(sets)), np.uint64)
                for k in range(2):
                    np.add.at(prints[k], row, mix(flat + np.uint64(k + 1)))
                parity = np.zeros((len(sets), PARITY), np.uint64)
                bit = mix(flat * _P)
                np.bitwise_xor.at(parity, (row, (bit % np.uint64(PARITY)).astype(np.int64)), np.uint64(1) << (bit >> np.uint64(58)))
                columns = [prints[0], prints[1], *parity.T]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(n),
                        *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns),
                        sketches(bit >> np.uint64(3), n),
                    ],
                    ["id", "n", "f1", "f2", *(f"p{k}" for k in range(PARITY)), "sketch"],
                )

    bits = ", ".join(f"p{k} long" for k in range(PARITY))
    return docs.mapInArrow(run, f"id long, n long, f1 long, f2 long, {bits}, sketch binary")


def _index(docs: DataFrame, size: int, bands: Bands, ways: dict[int, str] | None = None) -> DataFrame:
    """(sig, id, kind); of equal sets in one task only the first is indexed, equal sets being linked anyway."""

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE):
                ids, sigs, kinds = [], [], []
                for doc, values in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text").to_pylist(), size)):
                    if doc is None or not len(values):
                        continue
                    key = len(values).to_bytes(8, "little") + mix(values).sum(dtype=np.uint64).tobytes() + values.sum(dtype=np.uint64).tobytes()
                    if key in seen:
                        continue
                    seen.add(key)
                    s, k = signatures(values, bands, ways)
                    ids.append(np.full(len(s), doc, np.int64))
                    sigs.append(s)
                    kinds.append(k)
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(kinds))],
                        ["sig", "id", "kind"],
                    )

    return docs.mapInArrow(run, "sig long, id long, kind byte")


def _likely(pairs: DataFrame, bits: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b), a table already written, that sizes and sketches don't rule out; an id with different texts has none."""
    pairs = joinable(pairs, 16)
    left, right = (bits.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    right = right.join(pairs.select("b"), "b", "left_semi")

    def run(batches):
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b"))):
                ok.append(
                    x is None
                    or y is None
                    or bands.den * min(n, m) >= bands.num * max(n, m)
                    and (bands.den + bands.num) * least_difference(x, y) <= (bands.den - bands.num) * (n + m)
                )
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, bits: DataFrame, size: int, bands: Bands) -> DataFrame:
    """The pairs (a, b), a table already written, that are links."""
    pairs = joinable(saved(_likely(pairs, bits, bands), "likely"), 16)
    left = docs.select(F.col("id").alias("a"), F.col("text").alias("left"))
    # of the right side only the texts in pairs are dealt out
    right = docs.select(F.col("id").alias("b"), F.col("text").alias("right")).join(pairs.select("b"), "b", "left_semi")

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "left", SLICE // 2):
                one = shingle_sets(batch.column("left").to_pylist(), size)
                two = shingle_sets(batch.column("right").to_pylist(), size)
                ok = []
                for x, y in zip(one, two):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and bands.den * both >= bands.num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays(
                    [c.filter(pa.array(ok)) for c in (batch.column("a"), batch.column("b"))], ["a", "b"]
                )

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ends of edges (a, b), a table already written: the least id that edges reach.

    Large and small stars in turn: every node tells its larger neighbours, then
    its smaller ones and itself, the least node it knows, until nothing changes.
    Hot nodes only send minima through aggregation.  A turn never adds edges, so
    few of them stay few and are followed in one partition, without shuffles.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    few = edges.count() <= FEW_EDGES
    dealt = lambda df: df.coalesce(1) if few else df
    edges = dealt(saved(dealt(edges).distinct(), "edges"))
    before = None
    while True:
        both = edges.select(F.inline(ends))
        # large star: b > a goes to the least neighbour of a
        root = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.where("b > a").join(root, "a").select(F.col("root").alias("a"), "b").distinct()
        large = dealt(saved(large, "large"))
        # small star: of b and its smaller neighbours, all go to the least of them
        root = large.groupBy("b").agg(F.min("a").alias("root"))
        small = large.join(root, "b")
        told = F.explode(F.array("a", "b")).alias("b")
        edges = dealt(saved(small.select(F.col("root").alias("a"), told).where("a <> b").distinct(), "edges"))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "id")


def _joined(known: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) like ``known`` after more links (a, b), both tables already written: only the components that links touch are followed."""
    of = joinable(known, 16)
    label = lambda c: of.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    between = between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    # a component's own id is no row of ``known``, so no id comes twice
    roots = saved(components(saved(between, "between")), "roots")
    new = joinable(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), 16)
    moved = known.join(new, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return saved(moved.unionByName(roots), "components")


def _groups(index: DataFrame) -> DataFrame:
    """(sig, id, kind, prev): members of groups that can make a pair, and the member before each by contents."""
    order = Window.partitionBy("sig").orderBy(F.desc("kind"), "id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        index.withColumn("prev", F.lag("id").over(order))
        .withColumn("next", F.lead("id").over(order))
        .withColumn("top", F.first("kind").over(upto))
        .where("(prev IS NOT NULL OR next IS NOT NULL) AND (kind = 0 OR top = 2)")
        .select("sig", "id", "kind", F.when(F.col("kind") == 0, F.col("prev")).alias("prev"))
    )


def _proposed(groups: DataFrame, equal: DataFrame) -> DataFrame:
    """(a, b): for each set b the one before it in most groups, if that isn't an equal one."""
    proposed = (
        groups.where("prev <> id")
        .groupBy("id", "prev")
        .count()
        .groupBy("id")
        .agg(F.max(F.struct("count", "prev")).alias("best"))
        .select(F.col("best.prev").alias("a"), F.col("id").alias("b"))
    )
    of = joinable(equal, 16).select(F.col("b").alias("id"), F.col("a").alias("same"))
    same = lambda c: F.coalesce(F.col(f"same_{c}"), F.col(c))
    return saved(
        proposed.join(of.select(F.col("id").alias("a"), F.col("same").alias("same_a")), "a", "left")
        .join(of.select(F.col("id").alias("b"), F.col("same").alias("same_b")), "b", "left")
        .where(same("a") != same("b"))
        .select("a", "b"),
        "proposed",
    )


def _band() -> Column:
    return F.col("sig").bitwiseAND(F.lit(int(_BAND)))


def _pairs(open_: DataFrame) -> dict[int, float]:
    """The pairs that the open groups of each band would make."""
    s, must = F.col("s").cast("double"), F.col("must").cast("double")
    groups = open_.groupBy("sig").agg(
        F.count(F.lit(1)).alias("s"), F.count_if(F.col("kind") == 2).alias("must"), F.max("kind").alias("top")
    )
    made = F.when(F.col("top") == 0, s * (s - 1) / 2).otherwise(must * (s - must) + must * (must - 1) / 2)
    return {r.band: r.pairs for r in groups.groupBy(_band().alias("band")).agg(F.sum(made).alias("pairs")).collect()}


def _ways(open_: DataFrame, pairs: dict[int, float], bands: Bands) -> dict[int, str]:
    """The bands where another cut costs fewer rows than the open groups make pairs, with the cheapest such cut."""
    sets = open_.groupBy(_band().alias("band"), "id").agg(F.max("n").alias("n"))
    ways = {}
    for r in sets.groupBy("band").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements")).collect():
        lows = bands.lows(1 << BAND_BITS)
        while len(lows) < r.band + 2:
            lows = bands.lows(lows[-1] * 2)
        m = bands.segments(lows[r.band], lows[r.band + 1])
        if m == 1:  # sets that agree there are equal
            continue
        rows = {"near": (r.elements or 0) + r.sets * near_segments(m), "twice": r.sets * (m + 1) * m // 2}
        way = min(rows, key=rows.get)
        if rows[way] < pairs[r.band]:
            ways[r.band] = way
    return ways


def _allocated(open_: DataFrame, texts: DataFrame, first: DataFrame, bits: DataFrame, size: int, bands: Bands) -> DataFrame:
    """The open groups, with those of dear bands exchanged for groups by a finer cut where that makes fewer pairs."""
    pairs = _pairs(open_)
    ways = _ways(open_, pairs, bands)
    if not ways:
        return open_
    finer = saved(_groups(_index(texts, size, bands, ways)).select("sig", "id", "kind"), "finer")
    finer = _still_open(finer, first, bits)
    now = _pairs(finer)
    better = [band for band in ways if now.get(band, 0.0) < pairs[band]]
    return saved(
        open_.where(~_band().isin(better)).unionByName(finer.where(_band().isin(better))), "allocated"
    ) if better else open_


def _still_open(groups: DataFrame, components: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """Rows of the groups with more than one component, with that component ``c`` and the parity bits, if they have none yet."""
    label = F.coalesce("component", "id").alias("c")
    columns = [c for c in groups.columns if c != "c"]
    labelled = groups.join(joinable(components, 16), "id", "left").select(*columns, label)
    group = Window.partitionBy("sig")
    ends = labelled.withColumn("low", F.min("c").over(group)).withColumn("high", F.max("c").over(group))
    rest = ends.where("low <> high").drop("low", "high")
    return saved(rest if bits is None else rest.join(bits.drop("sketch"), "id"), "open")


def _may_link(bands: Bands):
    """Whether x and y are of different components and can be similar: the parities differ in no more bits than sets do."""
    bit = lambda k: F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}")))
    differ = sum((bit(k) for k in range(1, PARITY)), bit(0))
    total = F.col("x.n") + F.col("y.n")
    similar = (bands.den * F.least("x.n", "y.n") >= bands.num * F.greatest("x.n", "y.n")) & (
        (bands.den + bands.num) * differ <= (bands.den - bands.num) * total
    )
    # an id with different texts has no bits, and anything may link with it
    return (
        (F.col("x.c") != F.col("y.c"))
        & ((F.col("x.kind") == 0) | (F.col("x.kind") == 2) | (F.col("y.kind") == 2))
        & (similar | F.col("x.n").isNull() | F.col("y.n").isNull())
    )


def _bits(facts: DataFrame) -> DataFrame:
    """(id, n, p0 .., sketch): size and parity bits of each id; null if it has different sets."""
    columns = ["n", "f1", "f2", *(f"p{k}" for k in range(PARITY))]
    ends = facts.groupBy("id").agg(F.min(F.struct(*columns)).alias("low"), F.max(F.struct(*columns)).alias("high"), F.first("sketch").alias("sketch"))
    same = F.col("low") == F.col("high")
    bits = [F.when(same, F.col("low").getField(c)).alias(c) for c in columns if c not in ("f1", "f2")]
    return ends.select("id", *bits, F.when(same, F.col("sketch")).alias("sketch"))


def _first_met(open_: DataFrame) -> DataFrame:
    """Adds ``earliest``, the first groups of each id by contents in the order of their signatures."""
    earliest = open_.groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.when(F.col("kind") == 0, F.col("sig")))), 1, EARLIEST).alias("earliest"))
    return open_.join(earliest, "id")


def link_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """(id_col, n_shingles, component_id), one row for each row of ``docs``."""
    spark = docs.sparkSession
    bands = Bands(*share)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    facts = saved(_facts(rows, size), "facts")
    known = facts.where("n > 0 AND id IS NOT NULL")
    equal = known.groupBy("n", "f1", "f2").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a <> most")
    equal = saved(known.join(equal, ["n", "f1", "f2"]).select("a", F.col("id").alias("b")).where("a <> b"), "equal")

    groups = saved(_groups(_index(rows, size, bands)), "groups")
    release(spark)
    proposed = _proposed(groups, equal)
    bits = saved(_bits(facts), "bits")
    links = saved(_verified(proposed, rows, bits, size, bands), "links")
    release(spark)
    first = saved(components(equal.unionByName(links)), "components")

    left_over = _still_open(groups.select("sig", "id", "kind"), first, bits)
    ids = saved(left_over.select("id").distinct(), "open-ids")
    texts = saved(rows.join(joinable(ids, 16), "id", "left_semi"), "open-texts")
    release(spark)
    left_over, turn = _allocated(left_over, texts, first, bits, size, bands), 0
    release(spark)
    while True:
        # the set before it in a new order, if it is of another component and may be similar
        order = Window.partitionBy("sig").orderBy(F.xxhash64("id", F.lit(turn)), "id")
        other = F.lag(F.struct(*left_over.columns)).over(order)
        beside = left_over.alias("x").withColumn("y", other).where(_may_link(bands))
        tried = (
            beside.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
            .count()
            .groupBy("a")
            .agg(F.max(F.struct("count", "b")).alias("best"))
            .select("a", F.col("best.b").alias("b"))
        )
        tried = saved(tried, "tried")
        links = saved(_verified(tried, texts, bits, size, bands), "links")
        found = links.count()
        if not found:
            break
        first = _joined(first, links)
        left_over, turn = _still_open(left_over, first), turn + 1
        if found < WORTH * tried.count():
            break
    release(spark)
    left_over = _first_met(left_over)
    x, y = left_over.alias("x"), left_over.alias("y")
    ordered = F.col("x.c") < F.col("y.c")
    before = lambda side: F.filter(f"{side}.earliest", lambda s: s < F.col(f"{side}.sig"))
    # only groups by contents count: in the earliest of those that a pair has in common it isn't left out
    met = F.arrays_overlap(before("x"), before("y")) & (F.col("x.kind") == 0) & (F.col("y.kind") == 0)
    crossing = saved(
        x.join(y, (F.col("x.sig") == F.col("y.sig")) & ordered & _may_link(bands) & ~met)
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .distinct(),
        "crossing",
    )
    release(spark)
    more = saved(_verified(crossing, texts, bits, size, bands), "more-links")
    final = first if more.isEmpty() else _joined(first, more)
    release(spark)
    return facts.select("id", "n").join(joinable(final, 16), "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents with the least id of their component, with all their columns."""
    gone = saved(
        link_components(docs, id_col=id_col, **how)
        .where(F.col(id_col) != F.col("component_id"))
        .select(id_col)
        .distinct(),
        "gone",
    )
    return docs.join(joinable(gone, 16), id_col, "left_anti").select(docs.columns)
