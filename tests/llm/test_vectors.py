"""Vector operators against brute force, with ties, repeated rows, nulls, odd widths and clashing columns."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import centroid_bounds, topk_search, vector_codes
from runlens.llm.vectors import products, squared_distances

CLASHING = ["id", "x", "y", "cluster", "was", "key", "bucket", "block", "row", "norm", "threshold", "score", "rank", "codes", "error", "slot", "pos", "s"]


def made(n, width, seed, hot=0.0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(5)]
    out = []
    for i in range(n):
        c = centres[0] if rng.random() < hot else [v + rng.gauss(0, 0.3) for v in rng.choice(centres)]
        size = rng.choice([0.2, 0.5, 1.0, 3.0])
        out.append((i, [float(np.float32(v * size)) for v in c] if c is not centres[0] else [float(np.float32(v)) for v in c], rng.choice([0, 1, None])))
    return out


def odd(width):
    """Rows that take no part, and some that do: repeated, with a null id, zero, too short."""
    fine = [0.25] * width
    return [
        (None, fine, 1),
        (7, fine, None),
        (7, fine, None),
        (1000, None, 1),
        (1001, [], 1),
        (1002, [None, *fine[1:]], 1),
        (1003, [math.nan, *fine[1:]], 1),
        (1004, [math.inf, *fine[1:]], 1),
        (1005, [0.0] * width, 1),
        (1006, [-0.25] * width, 1),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def ints(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def lloyd(rows, k, rounds, scale, width):
    kept = [(i, ints(v, scale)) for i, v, _ in rows if usable(v) and len(v) == width]
    mark = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [x for _, x in sorted(kept, key=mark)[:k]]
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    assign = lambda: [min((d2(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, a) in zip(kept, of) if a == j]
            if mine:
                centroids[j] = [math.floor(sum(c) / len(mine)) if len(mine) < 1 << 20 else 0 for c in zip(*mine)]
    return sorted(((i, a, d) for (i, _), (d, a) in zip(kept, assign())), key=repr), centroids


@pytest.mark.parametrize("k", [1, 4, 9])
def test_clusters_equal_plain_lloyd(spark, k):
    rows = made(400, 6, 3, hot=0.3) + odd(6) + [(2000, [1.0] * 5, 0), (2001, [1.0] * 7, 0)]
    found, centroids, scanned = centroid_bounds.cluster(frame(spark, rows), k=k, rounds=5, scale=8, width=6)
    want, wanted = lloyd(rows, k, 5, 8, 6)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert centroids.tolist() == wanted
    assert scanned[0] == len(want) and all(n <= scanned[0] for n in scanned)


def test_only_expired_vectors_are_compared_again(spark):
    """Three tight groups far apart: after the first rounds no gap expires."""
    rng = random.Random(1)
    rows = [(i, [100.0 * (i % 3) + rng.gauss(0, 0.1), rng.gauss(0, 0.1)], 0) for i in range(900)]
    found, _, scanned = centroid_bounds.cluster(frame(spark, rows), k=3, rounds=6, scale=256, width=2)
    want, _ = lloyd(rows, 3, 6, 256, 2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert scanned[0] == 900 and scanned[-1] == 0


def test_clusters_of_few_or_no_vectors(spark):
    few = frame(spark, [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)])
    found, centroids, _ = centroid_bounds.cluster(few, k=40, width=2)
    assert sorted(r["distance"] for r in found.collect()) == [0, 0] and len(centroids) == 2
    empty, centroids, _ = centroid_bounds.cluster(frame(spark, odd(2)[3:8]), width=2)
    assert empty.count() == 0 and len(centroids) == 0


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="reaches"):
        centroid_bounds.cluster(frame(spark, [(1, [1e30, 0.0], 0)]), width=2)


def test_cover_tree_holds_every_point_once():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-50, 50, (300, 4)), np.zeros((40, 4), np.int64), np.full((3, 4), 9)])
    tree = vector_codes.CoverTree.build(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for i in range(len(tree.radius)):
        mine = points[tree.order[tree.begin[i] : tree.end[i]]]
        assert tree.sums[i].tolist() == mine.sum(axis=0).tolist()
        assert np.sqrt(((mine - tree.centre[i]) ** 2).sum(axis=1)).max() == pytest.approx(tree.radius[i])
        children = range(tree.first[i], tree.last[i])
        if tree.radius[i] > 0:
            assert sum(tree.end[j] - tree.begin[j] for j in children) == len(mine)
            assert all(tree.radius[j] <= tree.radius[i] / 2 + 1e-9 for j in children)
        else:
            assert len(children) == 0
    book = rng.integers(-50, 50, (20, 4))
    best = ((points[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert tree.codes(book).tolist() == best.tolist()
    # a tight group far from all but one entry goes there as a whole
    tight = vector_codes.CoverTree.build(rng.integers(0, 3, (200, 4)))
    nodes = sum(len(n) for n, _ in tight.assign(np.array([[0, 0, 0, 0], [500, 0, 0, 0]])))
    assert nodes == 1


def codes(rows, parts, entries, rounds, scale):
    kept = [(i, ints(v, scale), label) for i, v, label in rows if usable(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    step = width // parts
    cut = lambda x, p: x[p * step : (p + 1) * step]
    books = [[cut(x, p) for _, x, _ in [r for r in order if len(r[1]) == width][:entries]] for p in range(parts)]
    d2 = lambda a, b: sum((m - n) ** 2 for m, n in zip(a, b))
    assign = lambda p: [min((d2(cut(x, p), e), j) for j, e in enumerate(books[p])) for _, x, _ in kept]
    for _ in range(rounds):
        for p in range(parts):
            of = assign(p)
            for j in range(len(books[p])):
                mine = [cut(x, p) for (_, x, _), (_, a) in zip(kept, of) if a == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [assign(p) for p in range(parts)]
    out = [(i, label, [last[p][n][1] for p in range(parts)], sum(last[p][n][0] for p in range(parts))) for n, (i, _, label) in enumerate(kept)]
    return sorted(out, key=repr), books


@pytest.mark.parametrize("chunk", [7, 1024])
def test_codes_equal_plain_lloyd(spark, chunk, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    rows = made(150, 6, 9, hot=0.3) + odd(6) + [(3000, [1.0] * 4, 2)]
    df = frame(spark, rows).withColumns({c: F.lit("z") for c in CLASHING})
    found, books = vector_codes.compress(df, parts=3, entries=12, rounds=3, scale=16)
    want, wanted = codes(rows, 3, 12, 3, 16)
    got = sorted(((r["id"], r["label"], list(r["codes"]), r["error"]) for r in found.collect()), key=repr)
    assert got == want
    assert [b.tolist() for b in books] == wanted


def test_codes_of_no_vectors_and_of_a_width_that_cant_be_cut(spark):
    for rows in ([], odd(6)[3:8], [(1, [1.0, 2.0, 3.0], 0)]):
        found, books = vector_codes.compress(frame(spark, rows), parts=4)
        assert found.count() == 0 and books == []


def best(rows, k, scale):
    kept = [(n, i, ints(v, scale)) for n, (i, v, _) in enumerate(rows) if usable(v)]
    out = []
    for n, i, q in kept:
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0, m) for m, j, c in kept if m != n)
            out += [(i, rank + 1, None if none else j, -s) for rank, (s, none, j, _) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket,block,coordinate", [(8, 3, 0.0), (16, 2, 0.6), (1 << 13, 1 << 12, 2.0)])
def test_search_equals_brute_force(spark, bucket, block, coordinate, monkeypatch):
    for name, value in (("BUCKET", bucket), ("BLOCK", block), ("COORDINATE", coordinate)):
        monkeypatch.setattr(topk_search, name, value)
    rows = made(240, 6, 11, hot=0.3) + odd(6) + [(40, [0.5] * 6, 0), (2020, [1.0] * 4, 1), (2040, [0.0] * 6, 1)]
    df = frame(spark, rows).withColumns({c: F.lit("z") for c in CLASHING})
    got = topk_search.search(df, F.col("vec_id") % 20 == 0, k=5, scale=16)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best(rows, 5, 16)


def test_search_of_few_or_no_rows(spark):
    asks = F.col("vec_id") % 20 == 0
    assert topk_search.search(frame(spark, []), asks).count() == 0
    assert topk_search.search(frame(spark, [(1, [1.0], 0)]), asks).count() == 0
    assert topk_search.search(frame(spark, [(20, [1.0], 0)]), asks).count() == 0
    two = topk_search.search(frame(spark, [(20, [1.0], 0), (21, [2.0], 0)]), asks)
    assert [tuple(r) for r in two.collect()] == [(20, 1, 21, 64 * 128)]


def test_kernel_prunes_without_loss():
    """Bucket, length and coordinate pruning keep all candidates that reach the threshold."""
    rng = np.random.default_rng(2)
    c = rng.integers(-60, 60, (500, 8))
    norm = np.sqrt((c * c).sum(axis=1).astype(float))
    order = np.argsort(-norm)
    c, norm = c[order], norm[order]
    q = rng.integers(-60, 60, (40, 8))
    scores = q @ c.T
    threshold = np.sort(scores, axis=1)[:, -7].astype(float)
    side = {"y": q, "norm": np.sqrt((q * q).sum(axis=1).astype(float)), "row": -1 - np.arange(40), "threshold": threshold}
    other = {"y": c, "norm": norm, "row": np.arange(500), "id": np.arange(500), "unit": c / norm[:, None]}
    a, b, s = topk_search.best_in_bucket(side, other, 7)
    for i in range(40):
        want = sorted((-scores[i, j], j) for j in range(500))[:7]
        assert [(-x, y) for x, y in zip(s[a == i], b[a == i])] == want
    cosine = threshold / (side["norm"] * norm[0])
    assert ((cosine >= topk_search.COORDINATE).any() and (cosine < topk_search.COORDINATE).any()) or len(set(cosine > 0.6)) == 1


def test_exact_products():
    rng = np.random.default_rng(3)
    for size in (1 << 10, 1 << 22, 1 << 28):
        a, b = rng.integers(-size, size, (9, 64)), rng.integers(-size, size, (7, 64))
        want = [[sum(int(x) * int(y) for x, y in zip(r, t)) for t in b] for r in a]
        assert products(a, b).astype(np.int64).tolist() == want
        gaps = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, t)) for t in b] for r in a]
        assert squared_distances(a, b).astype(np.int64).tolist() == gaps
