"""Vector, pairwise, sequence, grid and text operators against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import clustering as KM
from runlens.operators import grid as G
from runlens.operators import learning as ML
from runlens.operators import neural as NN
from runlens.operators import pairs as PR
from runlens.operators import sequences as SQ
from runlens.operators import text as TX
from runlens.operators.optimise import Point, descend


def vectors(spark, matrix):
    rows = [(i, [float(x) for x in row] if row is not None else None) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id int, vec array<double>")


# -- k-means ----------------------------------------------------------------
def test_kmeans_step(spark):
    points = vectors(spark, [[0, 0], [1, 0], [10, 0], [11, 0], [5.5, 0], None])
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [11.0, 0.0]), (2, [99.0, 0.0])], "cluster int, centroid array<double>")
    assigned = KM.kmeans_assign(points, centres)
    got = {r["id"]: (r["cluster"], r["d2"]) for r in assigned.collect()}
    assert got == {0: (0, 0.0), 1: (0, 1.0), 2: (1, 1.0), 3: (1, 0.0), 4: (0, 30.25), 5: (None, None)}
    updated = KM.kmeans_update(assigned, centres)
    new = {r["cluster"]: (r["n"], r["centroid"]) for r in updated.collect()}
    assert new[1] == (2, [10.5, 0.0]) and new[2] == (0, [99.0, 0.0])  # an empty cluster stays
    assert new[0][1] == pytest.approx([6.5 / 3, 0.0])
    inertia = KM.kmeans_inertia(assigned, updated).first()[0]
    assert inertia == pytest.approx(0.5 + sum((x - 6.5 / 3) ** 2 for x in (0, 1, 5.5)))


def test_assignment_in_blocks_of_centroids(spark, monkeypatch):
    """More centroids than a block, with equal ones: the lowest number wins across blocks."""
    rng = np.random.default_rng(6)
    x, c = rng.normal(0, 2, (200, 4)), rng.normal(0, 2, (37, 4))
    c[[20, 33]] = c[[4, 9]]
    points = vectors(spark, [*x.tolist(), None])
    centres = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "cluster int, centroid array<double>")
    d2 = ((x[:, None, :] - c[None]) ** 2).sum(2)
    for block in (1, 5, 10_000):
        monkeypatch.setattr(KM, "BLOCK", block)
        got = {r["id"]: (r["cluster"], r["d2"]) for r in KM.kmeans_assign(points, centres).collect()}
        assert [got[i][0] for i in range(200)] == d2.argmin(1).tolist()
        assert [got[i][1] for i in range(200)] == pytest.approx(d2.min(1).tolist())
        assert got[200] == (None, None)


def lloyd(x, centres, max_iter):
    history, before = [], None
    for _ in range(max_iter + 1):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        if before is not None and (own == before).all():
            break
        if before is not None:
            history.append(((x - centres[before]) ** 2).sum())
        before = own
        centres = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
    return centres, history


def test_kmeans_fit(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.5, (60, 3)) for c in (0, 4, 8)])
    df = vectors(spark, x.tolist()).repartition(5)
    start = x[[0, 1, 2, 100]]
    centres, history = KM.kmeans_fit(df, 4, "id", start=start.tolist(), max_iter=50)
    want, inertias = lloyd(x, start, 50)
    got = np.array([r["centroid"] for r in centres.orderBy("cluster").collect()])
    assert np.allclose(got, want)
    mine = [r["inertia"] for r in history.orderBy("step").collect()]
    assert mine == pytest.approx(inertias)
    assert all(r["converged"] for r in history.collect())
    _, cut = KM.kmeans_fit(df, 4, "id", start=start.tolist(), max_iter=2)
    assert not any(r["converged"] for r in cut.collect())
    assert all(a >= b - 1e-9 for a, b in zip(mine, mine[1:]))
    again = KM.initial_centroids(df.repartition(3), 4, 9, "id")
    assert np.array_equal(again, KM.initial_centroids(df, 4, 9, "id"))


# -- pairs ------------------------------------------------------------------
def points_xy(spark, n, seed, name):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} int, x double, y double"), rows


@pytest.mark.parametrize("block_rows", [1000, 4])
def test_pairwise_distance(spark, block_rows):
    a, ra = points_xy(spark, 23, 1, "i")
    b, rb = points_xy(spark, 17, 2, "j")
    got = {(r["i"], r["j"]): r["d"] for r in PR.pairwise_distance(a, b, block_rows=block_rows).collect()}
    assert len(got) == 23 * 17
    for i, x, y in ra:
        for j, u, v in rb:
            assert got[i, j] == pytest.approx(math.hypot(x - u, y - v))


def test_distance_fixture(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0)], "i int, x double, y double")
    b = spark.createDataFrame([(1, 3.0, 4.0)], "j int, x double, y double")
    assert PR.pairwise_distance(a, b).first()["d"] == 5.0


@pytest.mark.parametrize("block_rows", [1000, 2])
def test_kernels_and_svm(spark, block_rows):
    rng = np.random.default_rng(0)
    x, s = rng.normal(size=(8, 3)), rng.normal(size=(5, 3))
    a = vectors(spark, x.tolist()).withColumnRenamed("id", "i")
    b = vectors(spark, s.tolist()).withColumnRenamed("id", "j")
    want = {
        "linear": x @ s.T + 0.5,
        "poly": (0.3 * (x @ s.T) + 0.5) ** 2,
        "rbf": np.exp(-0.3 * ((x[:, None] - s[None]) ** 2).sum(2)),
    }
    for name, matrix in want.items():
        got = PR.kernel_matrix(a, b, name, degree=2, coef0=0.5, gamma=0.3, block_rows=block_rows).collect()
        assert len(got) == 40
        for r in got:
            assert r["k"] == pytest.approx(matrix[r["i"], r["j"]])
    alpha, y = [0.1, 0.4, 0.2, 0.5, 0.3], [1, -1, 1, -1, 1]
    support = spark.createDataFrame([(v.tolist(), p, q) for v, p, q in zip(s, alpha, y)], "vec array<double>, alpha double, y int")
    scored = PR.kernel_svm_score(a, support, 0.05, "rbf", gamma=0.3, block_rows=block_rows).collect()
    for r in scored:
        score = want["rbf"][r["i"]] @ (np.array(alpha) * y) + 0.05
        assert r["score"] == pytest.approx(score) and r["predicted"] == (1 if score > 0 else -1)
    with pytest.raises(ValueError, match="unknown kernel"):
        PR.kernel_matrix(a, b, "cubic")
    with pytest.raises(ValueError, match="gamma"):
        PR.kernel_matrix(a, b, "rbf", gamma=-1)


@pytest.mark.parametrize("block_rows", [1000, 5])
def test_interaction(spark, block_rows):
    rng = random.Random(8)
    rows = [(i, float(rng.randint(0, 4)), float(rng.randint(0, 4)), rng.uniform(1, 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, y double, mass double")
    got = {r["id"]: (r["fx"], r["fy"]) for r in PR.pairwise_interaction(df, "id", 0.5, 2.0, block_rows).collect()}
    for i, x, y, _ in rows:
        fx = sum(2 * m * (u - x) / ((u - x) ** 2 + (v - y) ** 2 + 0.5) ** 1.5 for j, u, v, m in rows if j != i)
        fy = sum(2 * m * (v - y) / ((u - x) ** 2 + (v - y) ** 2 + 0.5) ** 1.5 for j, u, v, m in rows if j != i)
        assert got[i] == pytest.approx((fx, fy))


# -- sequences --------------------------------------------------------------
def test_next_across_empty_chunks(spark):
    rng = random.Random(2)
    times = sorted(rng.sample(range(10_000), 60))
    df = spark.createDataFrame([("k", t) for t in times] + [("one", 5)], "k string, t int")
    got = SQ.with_next(df, ["k"], ["t"], ["t"], F.floor(F.col("t") / 100)).collect()
    assert len(got) == 61
    links = {r["t"]: r["next"] and r["next"]["t"] for r in got if r["k"] == "k"}
    assert links == dict(zip(times, times[1:] + [None]))
    assert [r["next"] for r in got if r["k"] == "one"] == [None]


def test_route_and_edges(spark):
    stops = spark.createDataFrame([("r", 0, "0", 0.0, 0.0), ("r", 1, "1", 2.0, 2.0), ("s", 0, "0", 0.0, 0.0)], "route string, seq int, node string, x double, y double")
    legs = SQ.route_legs(stops, "route", ["seq"], F.floor(F.col("seq") / 1))
    lengths = SQ.route_length(legs, "route")
    assert [tuple(r) for r in lengths.collect()] == [("r", 2, pytest.approx(5.656854249492381))]
    assert SQ.shortest_route(lengths, "route").first()["route"] == "r"
    edges = spark.createDataFrame([(a, b, 1.0) for a in "01" for b in "01"], "from_node string, to_node string, weight double")
    got = {(r[0], r[1]): r[2] for r in SQ.edge_weights(edges, legs, lengths, "route", 0.7, 10).collect()}
    assert got["0", "1"] == got["1", "0"] == pytest.approx(4.235533905932737)
    assert got["0", "0"] == got["1", "1"] == pytest.approx(0.7)


def test_transition_probability_sums_to_one(spark):
    rows = [("a", i, 1.0 + i, 2.0 + i % 3) for i in range(10)] + [("b", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "source string, target int, weight double, distance double")
    probs = SQ.transition_probability(df, "source", "target", 1.0, 5.0)
    sums = {r[0]: r[1] for r in probs.groupBy("source").agg(F.sum("prob")).collect()}
    assert sums == {"a": pytest.approx(1.0), "b": pytest.approx(1.0)}
    score = {i: w * (1 / d) ** 5 for s, i, w, d in rows if s == "a"}
    for r in probs.filter("source = 'a'").collect():
        assert r["prob"] == pytest.approx(score[r["target"]] / sum(score.values()))
    picks = [SQ.weighted_pick(probs.repartition(n), "source", "target", 5).collect() for n in (1, 4)]
    assert sorted(picks[0]) == sorted(picks[1])
    drawn = [SQ.weighted_pick(probs.filter("source = 'a'"), "source", "target", s).first()["target"] for s in range(40)]
    assert len(set(drawn)) > 2


def test_semidivisible_totals(spark):
    """Known totals of the rule with the squares of primes as given breakpoints (fixed values)."""
    small = [n for n in range(2, 140) if all(n % d for d in range(2, n))]
    squares = spark.createDataFrame([(float(n * n),) for n in small], "square double")
    for limit, want in ((1000, 34825), (10_000, 1134942)):
        values = spark.range(4, limit + 1).withColumnRenamed("id", "v")
        bounded = SQ.neighbour_bounds(values, "v", squares, "square")
        assert bounded.count() == limit - 3
        assert SQ.divisible_by_one_bound(bounded, "v").agg(F.sum("v")).first()[0] == want


def test_primes_among_numbers(spark, monkeypatch):
    """Brute force, in blocks of a few multiples; numbers may be missing, repeated or null."""
    monkeypatch.setattr(SQ, "_STRUCK", 7)
    for numbers in (range(-3, 400), [n for n in range(0, 300) if n not in (2, 5, 14)], [], [1], [6, 6, 4, 3, 3]):
        want = {n for n in numbers if n >= 2 and not any(n % d == 0 for d in numbers if 2 <= d < n)}
        df = spark.createDataFrame([(n,) for n in [*numbers, None]], "k long")
        assert sorted(r["k"] for r in SQ.primes_upto(df, "k").collect()) == sorted(want)


def test_bounds_queries_use_the_primes(spark, tmp_path):
    """As in the program that this follows; suppliers have no part in them."""
    from runlens.plans.catalog import QUERIES

    spark.range(0, 10_001).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(0, 500).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert QUERIES["divisible_by_one_bound"](spark, str(tmp_path)).first()["total"] == 1134942
    got = {r["v"]: (r["lower"], r["upper"]) for r in QUERIES["neighbour_bounds"](spark, str(tmp_path)).collect()}
    assert len(got) == 10_001 and got[1000] == (31**2, 37**2) and got[4] == (4, 4) and got[3] == (None, 4)


def test_bounds_with_one_breakpoint_far_off(spark):
    values = spark.range(1, 5001).withColumnRenamed("id", "v")
    points = spark.range(10, 5001, 10).select(F.col("id").cast("double").alias("b"))
    far = points.unionByName(spark.createDataFrame([(1e12,), (-1e12,)], "b double"))
    got = {r["v"]: (r["lower"], r["upper"]) for r in SQ.neighbour_bounds(values, "v", far, "b").collect()}
    assert len(got) == 5000 and got[5] == (-1e12, 10.0) and got[15] == (10.0, 20.0) and got[5000] == (5000.0, 5000.0)
    empty = spark.createDataFrame([], "b double")
    assert {r["upper"] for r in SQ.neighbour_bounds(values, "v", empty, "b").collect()} == {None}


def test_ratio_total_has_no_limit(spark):
    """More denominators than any list on the driver should hold: 1/k - 1/(k+1) summed."""
    n = 12_000
    rows = spark.range(1, n + 1).selectExpr("1L AS num", "id * (id + 1) AS den")
    got = SQ.ratio_total(rows).first()
    assert (got["num"], got["den"], got["n_ratios"]) == (str(n), str(n + 1), n)


def test_grids_with_empty_windows(spark):
    grid = spark.createDataFrame([("g", 0, 0, 4.0), ("g", 1, 1, -2.0)], "id string, r int, c int, value double")
    conv = {(r["out_r"], r["out_c"]): r["value"] for r in G.conv2d_grid(grid, [[1.0, 0.0], [0.0, 1.0]], 6, 6, bias=0.5).collect()}
    assert len(conv) == 25 and conv[4, 4] == pytest.approx(1 / (1 + math.exp(0.5)))
    assert conv[0, 0] == pytest.approx(1 / (1 + math.exp(-1.5)))
    mean = {(r["out_r"], r["out_c"]): r["value"] for r in G.pool_grid(grid, 2, 6, 6).collect()}
    assert len(mean) == 9 and mean[0, 0] == 0.5 and mean[2, 2] == 0.0
    high = {(r["out_r"], r["out_c"]): r["value"] for r in G.pool_grid(grid.filter("r = 1"), 2, 6, 6, "max").collect()}
    assert high[0, 0] == 0.0 and len(high) == 9


def test_lda_without_variance_predicts_nothing(spark):
    from runlens.operators import learning as LE

    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "y string, x double")
    got = LE.lda_predict(df, LE.lda_fit(df, "y", "x"), "y", "x").collect()
    assert [r["predicted"] for r in got] == [None] * 4


def test_bounds_of_a_value_that_fills_several_ranges(spark):
    """Equal values are dealt over ranges; those in any of them see the same breakpoints."""
    values = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit(50.0)).otherwise(F.col("id").cast("double")).alias("v"))
    points = spark.createDataFrame([(50.0,), (40.0,), (2500.0,)], "b double")
    got = SQ.neighbour_bounds(values.repartition(6), "v", points, "b")
    assert {(r["lower"], r["upper"]) for r in got.where("v = 50").collect()} == {(50.0, 50.0)}
    assert {(r["lower"], r["upper"]) for r in got.where("v > 50 AND v < 2500").collect()} == {(50.0, 2500.0)}
    assert {(r["lower"], r["upper"]) for r in got.where("v > 2500").collect()} == {(2500.0, None)}
    assert got.count() == 3000


def test_bounds_windows_only_grow(spark):
    """A window from the current row to the last is read again for every row, so no plan may hold one."""
    values = spark.range(100).select(F.col("id").cast("double").alias("v"))
    bounded = SQ.neighbour_bounds(values, "v", values.withColumnRenamed("v", "b"), "b")
    plan = bounded._jdf.queryExecution().toString()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan.replace("$", "").lower()
    assert {(r["v"], r["lower"], r["upper"]) for r in bounded.collect()} == {(float(i),) * 3 for i in range(100)}


def test_bounds_outside_and_on_breakpoints(spark):
    points = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (1000.0,)], "b double")
    values = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (999.0,), (1000.0,), (5000.0,)], "v double")
    got = {r["v"]: (r["lower"], r["upper"]) for r in SQ.neighbour_bounds(values, "v", points, "b").collect()}
    assert got == {
        5.0: (None, 10.0), 10.0: (10.0, 10.0), 15.0: (10.0, 20.0), 999.0: (20.0, 1000.0),
        1000.0: (1000.0, 1000.0), 5000.0: (1000.0, None),
    }


def test_ratios(spark):
    thirds = spark.createDataFrame([(1, 3), (2, 6), (3, -9), (5, 0), (0, 7)], "a int, b int")
    got = {tuple(r) for r in SQ.canonical_ratio_distinct(thirds, "a", "b").collect()}
    assert got == {(1, 3), (-1, 3), (0, 1)}
    same = spark.createDataFrame([(1, 3)] * 3, "num bigint, den bigint")
    assert tuple(SQ.ratio_total(same).select("num", "den", "n_ratios").first()) == ("1", "1", 3)
    mixed = spark.createDataFrame([(2, 5), (4, 11), (12, 3)], "num bigint, den bigint")
    assert tuple(SQ.ratio_total(mixed).select("num", "den").first()) == ("262", "55")
    assert SQ.ratio_total(mixed.filter("false")).first()["total"] == 0.0


def test_energy_integral(spark):
    rows = [("r", 0.0, 10.0), ("r", 2.0, 20.0), ("r", 7201.0, 0.0), ("one", 3.0, 9.0)]
    df = spark.createDataFrame(rows, "run string, t double, w double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["run"]: r["joules"] for r in SQ.energy_integral(df, ["run"], "ts", "w").collect()}
    assert got == {"r": pytest.approx(30.0 + 7199 * 10.0), "one": 0.0}


# -- models -----------------------------------------------------------------
def test_lda(spark):
    rng = random.Random(6)
    rows = [(c, rng.gauss(5 * (c + 1), 1)) for c, n in enumerate((20, 25, 30)) for _ in range(n)]
    df = spark.createDataFrame(rows, "label int, x double")
    model = ML.lda_fit(df, "label", "x")
    fitted = {r["label"]: r for r in model.collect()}
    means = {c: np.mean([x for k, x in rows if k == c]) for c in range(3)}
    pooled = sum((x - means[c]) ** 2 for c, x in rows) / (75 - 3)
    assert fitted[0]["variance"] == pytest.approx(pooled) and fitted[2]["prior"] == pytest.approx(30 / 75)
    predicted = ML.lda_predict(df, model, "label", "x")
    for r in predicted.collect():
        score = {
            c: r["x"] * fitted[c]["mean"] / pooled - fitted[c]["mean"] ** 2 / (2 * pooled) + math.log(fitted[c]["prior"])
            for c in fitted
        }
        assert r["predicted"] == max(score, key=lambda c: (score[c], -c))
    assert ML.accuracy(predicted, "label", "predicted").first()["pct"] > 90
    tie = spark.createDataFrame([("b", 1.0), ("b", 3.0), ("a", 1.0), ("a", 3.0)], "label string, x double")
    assert {r["predicted"] for r in ML.lda_predict(tie, ML.lda_fit(tie, "label", "x"), "label", "x").collect()} == {"a"}


def test_accuracy_counts(spark):
    rows = [(i % 2, 0) for i in range(20)] + [(None, 0)]
    got = ML.accuracy(spark.createDataFrame(rows[:20], "a int, p int"), "a", "p").first()
    assert tuple(got) == (20, 10, 10, 50.0)
    assert ML.accuracy(spark.createDataFrame(rows, "a int, p int"), "a", "p").first()["incorrect"] == 11


def test_minmax_zero_range_is_null(spark):
    train = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    got = ML.minmax_scale(train, spark.createDataFrame([(2.0, 7.0), (5.0, 1.0)], "a double, b double"), ["a", "b"])
    assert [tuple(r) for r in got.collect()] == [(0.5, None), (2.0, None)]


def test_pairs_within(spark):
    rng = random.Random(9)
    near = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(150)] + [(150 + i, float(i % 4 - 2), -1.5) for i in range(20)]
    odd = [(900, None, 1.0), (901, math.nan, 0.0), (902, math.inf, 0.0)]
    a = spark.createDataFrame(near + odd, "i int, x double, y double")
    b = a.withColumnRenamed("i", "j")
    for radius in (0.5, 1.0):
        got = {(r["i"], r["j"]): r["d"] for r in PR.pairs_within(a, b, radius).collect()}
        want = {(p[0], q[0]): math.dist(p[1:], q[1:]) for p in near for q in near if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= radius**2}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert PR.pairs_within(a.limit(0), b, 1.0).count() == 0
    with pytest.raises(ValueError, match="radius"):
        PR.pairs_within(a, b, 0.0)


def test_pairs_within_of_a_crowded_cell(spark, monkeypatch):
    """A cell with many rows is cut on both sides, and tasks follow the pairs; ids and points may repeat."""
    monkeypatch.setattr(PR, "SLICE_ROWS", 7)
    monkeypatch.setattr(PR, "PAIRS_PER_TASK", 100)
    rng = random.Random(4)
    a = [(i // 2, rng.uniform(0, 1), 0.5) for i in range(60)] + [(500, 40.0, 40.0)]
    b = [(i % 25, rng.uniform(0, 1), 0.5) for i in range(30)] + [(600, -40.0, 40.0)]
    near = PR.pairs_within(
        spark.createDataFrame(a, "i int, x double, y double"), spark.createDataFrame(b, "j int, x double, y double"), 0.75
    )
    want = sorted((p[0], q[0]) for p in a for q in b if abs(p[1] - q[1]) <= 0.75 and abs(p[2] - q[2]) < 1)
    assert sorted((r["i"], r["j"]) for r in near.collect()) == want
    assert near.rdd.getNumPartitions() > 8


def test_linear_svm(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((1 if x + y > 0.1 else -1, x, y))
    df = spark.createDataFrame(rows, "label int, x double, y double")
    terms = ML.linear_svm_fit(df, "label", ["x", "y"]).collect()
    assert all(r["converged"] and 0 <= r["gap"] <= 1e-3 * r["objective"] for r in terms)
    assert not ML.linear_svm_fit(df, "label", ["x", "y"], max_iter=2).first()["converged"]
    predicted = ML.linear_svm_predict(df, [tuple(r)[:2] for r in terms])
    assert ML.accuracy(predicted, "label", "predicted").first()["pct"] > 90
    # no weights nearby are better by more than the gap
    data = np.array([[x, y, 1.0] for _, x, y in rows])
    sign = np.array([r[0] for r in rows])
    value = lambda w: w @ w / 2 + np.maximum(0, 1 - sign * (data @ w)).sum()
    w = np.array([r["weight"] for r in terms])
    assert value(w) == pytest.approx(terms[0]["objective"])
    noise = np.random.default_rng(4)
    for size in (1e-3, 1e-2, 0.1, 1.0):
        assert all(value(w + size * noise.normal(size=3)) >= value(w) - terms[0]["gap"] for _ in range(100))
    # missing values are left out; nothing but them is an error
    holes = df.unionByName(spark.createDataFrame([(1, None, 2.0), (None, 1.0, 1.0), (-1, math.nan, 0.0)], df.schema))
    few = [ML.linear_svm_fit(d, "label", ["x", "y"], max_iter=2).first()["objective"] for d in (df, holes)]
    assert few[0] == pytest.approx(few[1])
    with pytest.raises(ValueError, match="complete"):
        ML.linear_svm_fit(df.limit(0), "label", ["x", "y"])


def test_descent_to_a_known_minimum():
    def valley(x):  # narrow and curved, lowest at (1, 1)
        a, b = 1 - x[0], x[1] - x[0] ** 2
        return Point(x, a * a + 100 * b * b, np.array([-2 * a - 400 * x[0] * b, 200 * b]), {})

    walk = list(descend(valley, np.array([-1.2, 1.0]), lambda p: np.abs(p.gradient).max() < 1e-8, 200))
    assert walk[-1].x == pytest.approx([1, 1], abs=1e-6) and len(walk) < 80
    values = [p.value for p in walk]
    assert values == sorted(values, reverse=True)
    assert len(list(descend(valley, np.array([-1.2, 1.0]), lambda p: False, 3))) == 4


def test_mlp_score_and_fit(spark):
    weights = [np.array([[1.0]])]
    df = vectors(spark, [[1.0], [0.0], [2.0], None])
    got = [(r["score"], r["predicted"]) for r in NN.mlp_score(df, weights).orderBy("id").collect()]
    assert [g[0] for g in got] == pytest.approx([0.73105858, 0.5, 0.88079708, None])
    assert [g[1] for g in got] == [1, 0, 1, None]
    rows = [(i, [float(a), float(b), float(c)], a ^ b ^ c) for i, (a, b, c) in enumerate(np.ndindex(2, 2, 2))]
    data = spark.createDataFrame(rows, "id int, vec array<double>, label int").repartition(3)
    fitted, history = NN.mlp_fit(data, [4, 3], epochs=4, seed=2)
    rows_of = history.orderBy("epoch").collect()
    errors = [r["mse"] for r in rows_of]
    assert len(errors) == 5 and not rows_of[-1]["converged"]
    # either of two inputs is learnt to the bound on the slopes
    either = data.withColumn("label", F.greatest(F.col("vec")[0], F.col("vec")[1]))
    fitted, far = NN.mlp_fit(either, [4, 3], epochs=200, decay=1e-3, seed=2)
    far = far.orderBy("epoch").collect()
    assert far[-1]["converged"] and far[-1]["slope"] <= 1e-4 and not any(r["converged"] for r in far[:-1])
    total, error, n = NN._gradient(either.select("vec", "label"), fitted)
    slopes = np.concatenate([w.ravel() for w in fitted]) * 1e-3 - total / n
    assert np.abs(slopes).max() == pytest.approx(far[-1]["slope"]) and error / n == pytest.approx(far[-1]["mse"])
    # the first errors and slopes by hand
    x, y = np.array([r[1] for r in rows]), np.array([[r[2]] for r in rows])
    w = NN.start_weights([3, 4, 3, 1], 2)
    out = NN._forward(x, w)[-1]
    assert errors[0] == pytest.approx(((y - out) ** 2).mean()) and errors[-1] < errors[0]
    eps = 1e-6
    total, _, n = NN._gradient(data.select("vec", F.col("label").cast("double")), w)
    bumped = [v.copy() for v in w]
    bumped[0][1, 2] += eps
    slope = (((y - NN._forward(x, bumped)[-1]) ** 2).sum() - ((y - out) ** 2).sum()) / eps
    assert total[1 * 4 + 2] == pytest.approx(-slope, rel=1e-3) and n == 8


def test_normal_sample(spark):
    df = ML.normal_sample(spark.range(20_000), "id", 5.0, 2.0, 1, 3)
    m = df.agg(F.avg("x"), F.stddev_samp("x")).first()
    assert m[0] == pytest.approx(5.0, abs=0.06) and m[1] == pytest.approx(2.0, abs=0.05)
    again = ML.normal_sample(spark.range(20_000).repartition(3), "id", 5.0, 2.0, 1, 3)
    assert df.exceptAll(again).count() == 0


# -- grids and text ---------------------------------------------------------
def test_convolution_and_pooling(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(6, 7))
    a[2, 3] = 0.0
    cells = [("g", r, c, float(a[r, c])) for r in range(6) for c in range(7) if (r, c) != (2, 3)]
    grid = spark.createDataFrame(cells, "id string, r int, c int, value double")
    kernel = rng.normal(size=(3, 2))
    for stride in (1, 2):
        got = {(r["out_r"], r["out_c"]): r["value"] for r in G.conv2d_grid(grid, kernel.tolist(), 6, 7, stride, 0.3).collect()}
        want = {}
        for i, top in enumerate(range(0, 6 - 3 + 1, stride)):
            for j, left in enumerate(range(0, 7 - 2 + 1, stride)):
                net = (a[top : top + 3, left : left + 2] * kernel).sum() - 0.3
                want[i, j] = 1 / (1 + math.exp(-net))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    pooled = {(r["out_r"], r["out_c"]): r["value"] for r in G.pool_grid(grid, 3, 6, 7, "max").collect()}
    assert pooled[0, 0] == pytest.approx(a[:3, :3].max()) and len(pooled) == 6
    with pytest.raises(ValueError):
        G.pool_grid(grid, 3, 6, 7, "median")


def test_text(spark):
    df = spark.createDataFrame([("Helxo Worlx",), ("Hello World and more",), ("",), (None,)], "t string")
    got = [r["score"] for r in TX.positional_match(df, "t", "Hello World").collect()]
    assert got == [9, 11, 0, None]
    assert [r["t"] for r in TX.positional_match(df, "t", "Hello World", n=1).collect()] == ["Hello World and more"]
    alphabet = "abcdfghijklmnopqrtuvwxyz"
    rows = spark.createDataFrame([("test",), ("abc",), ("",)], "t string")
    assert [r["violations"] for r in TX.alphabet_violations(rows, "t", alphabet).collect()] == [["e", "s"], [], []]
