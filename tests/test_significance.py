"""Tests replayed on published values, and against closed forms."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

import probabilities as plain
from runlens.functions import pvalues as PV
from runlens.operators import compare as C
from runlens.operators import significance as T

# Percent changes of ten programs in four metrics, and what the
# published analysis found for them.
CHANGES = {
    "Energy %": [
        8.095238095238093, 351796.34844868735, -11.969111969111966, 30.409028557176693, -1.2474399553155908,
        -8.856390226178574, -95.92956672095585, 8667.569959075325, -33.476004006921045, -6.626630772416643,
    ],
    "CPU %": [
        -1.6054935539734643, 360.2281951319896, 1.3169052158324601, 40.25892615239139, -14.182928403459446,
        -0.9634659251027374, -3.2595935049688696, 31.645217429255702, 87.5430525487109, 4.483469742862659,
    ],
    "Memory %": [
        0.09881070619095411, 1.2127717481158473, 0.2793623306509211, 0.6851327460525676, 0.214608079930712,
        -0.07163106206338347, -0.30936370935367424, 2.2768199087953183, -0.281258702311335, 0.11958958681924799,
    ],
    "Power %": [
        6.793344930639184, 1800.1394994927289, -12.002553144252651, 1.4604077761972576, -1.4789357840676527,
        -8.333333333333332, -45.00929243975316, 425.8419275349093, -12.549167927382765, -6.291718702898224,
    ],
    "Time %": [None] * 10,
}
FOUND = {  # median, mean, sd, shapiro p, signed-rank p, t p
    "CPU %": (2.9001874793475597, 50.54642848335382, 112.910016895853, 3.12404853455893e-05, 0.193359375, 0.1905368118485997),
    "Energy %": (-3.9370353638661166, 36034.43175307642, 110980.98256192094, 1.3982824918123194e-07, 1.0, 0.33133690758850853),
    "Memory %": (0.16709883337498, 0.42248416328271754, 0.7935371547428435, 0.029821361712222848, 0.193359375, 0.1265443434073804),
    "Power %": (-3.885327243482939, 214.85701784027867, 573.7493706390092, 2.9893860012750753e-06, 0.76953125, 0.26666208904824285),
}
QUARTILES = {
    "Energy %": (-11.190931533378619, 24.83058094169204),
    "CPU %": (-1.4449866467557826, 38.10549897160747),
    "Memory %": (-0.029020619999799074, 0.583690142202156),
    "Power %": (-11.085248191522822, 5.4601106420287024),
}
CODE = [0.49964, 2.85196, 1.2078, 2.974375, 0.54562, 1.04112, 273.85708, 0.96254, 0.89796, 0.46092500000000003]
PARALLEL = [0.4916333333333333, 3.7183, 1.3865, 3.5315666666666665, 0.5392666666666667, 2.130533333333333, 342.8097, 27.3159, 0.9395333333333333, None]
DELTAS = [
    -1.6024871240626577, 30.377003885047483, 14.795495943036935, 18.73306717097428, -1.1644245689918482,
    104.63859433430662, 25.17832294129479, 2737.8976458121224, 4.62975336689088, None,
]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(m, x) for m, values in CHANGES.items() for x in values]
    return spark.createDataFrame(rows, "metric string, delta_pct double")


def test_published_tests(long):
    got = {r["metric"]: r for r in T.choose_test(long, ["metric"], "delta_pct").collect()}
    for metric, want in FOUND.items():
        r = got[metric]
        mine = [r[c] for c in ("median", "mean", "sd", "shapiro_p", "wilcox_p", "ttest_p")]
        assert mine == pytest.approx(list(want), rel=1e-9)
        assert r["n"] == 10 and r["test_used"] == "Wilcoxon" and r["p_value"] == r["wilcox_p"]
        assert r["significant"] is False and r["significance_label"] == "ns"
    empty = got["Time %"]
    assert empty["n"] == 10 and empty["significance_label"] == "ns"
    assert all(empty[c] is None for c in ("median", "shapiro_p", "wilcox_p", "ttest_p", "test_used", "significant"))


def test_published_summary(spark):
    names = {"Energy %": "energy", "Time %": "time", "CPU %": "cpu", "Memory %": "memory", "Power %": "power"}
    rows = [(f"b{i}", *[CHANGES[m][i] for m in names]) for i in range(10)]
    schema = "benchmark string, " + ", ".join(f"delta_{n}_pct double" for n in names.values())
    got = {r["metric"]: r for r in C.delta_summary_matrix(spark.createDataFrame(rows, schema)).collect()}
    for metric in QUARTILES:
        assert (got[metric]["q25"], got[metric]["q75"]) == pytest.approx(QUARTILES[metric], rel=1e-9)
        assert got[metric]["min"] == min(CHANGES[metric]) and got[metric]["max"] == max(CHANGES[metric])
    assert got["Time %"]["min"] is None and got["Time %"]["max"] is None


def test_published_treatments(spark):
    rows = [(f"b{i}", "CODE", x) for i, x in enumerate(CODE)]
    rows += [(f"b{i}", "PARALLEL", x) for i, x in enumerate(PARALLEL) if x is not None]
    slopes = spark.createDataFrame(rows, "benchmark string, treatment string, energy_mean double")
    got = {r["treatment"]: r for r in C.treatment_summary(slopes).collect()}
    assert got["CODE"]["energy_median"] == pytest.approx(1.00183)
    assert got["CODE"]["energy_mean"] == pytest.approx(28.529902)
    assert got["CODE"]["energy_sd"] == pytest.approx(86.20399777)
    assert got["PARALLEL"]["n_benchmarks"] == 9
    assert got["PARALLEL"]["energy_mean"] == pytest.approx(42.54032592592593)
    delta = C.treatment_delta(slopes, "CODE", "PARALLEL").orderBy("benchmark").collect()
    changes = [r["delta_energy_pct"] for r in delta]
    assert changes[:9] == pytest.approx(DELTAS[:9], rel=1e-9) and changes[9] is None


def test_signed_rank_against_all_sign_patterns(spark):
    want = {}
    for n in (1, 4, 7):
        sums = [sum(r for r, up in zip(range(1, n + 1), signs) if up) for signs in product((0, 1), repeat=n)]
        for v in range(n * (n + 1) // 2 + 1):
            low = sum(s <= v for s in sums) / len(sums)
            high = sum(s >= v for s in sums) / len(sums)
            want[n, v] = min(1, 2 * min(low, high))
            assert plain.signed_rank_exact(v, n) == pytest.approx(want[n, v])
    want |= {(49, v): plain.signed_rank_exact(v, 49) for v in (0, 300, 612, 613, 1000, 1225)}
    df = spark.createDataFrame([(n, float(v)) for n, v in want], "n bigint, v double")
    got = {(r.n, int(r.v)): r.p for r in df.withColumn("p", PV.signed_rank_exact(F.col("v"), F.col("n"))).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_signed_rank_normal_equals_the_library(spark):
    cases = [(float(v), n, ties) for n, v, ties in ((50, 900, 0.0), (60, 915, 6.0), (200, 9000, 120.0), (10**6, 2.4e11, 0.0), (7, 14, 6.0))]
    df = spark.createDataFrame(cases, "v double, n bigint, ties double")
    p = PV.signed_rank_normal(F.col("v"), F.col("n"), F.col("ties"))
    for r in df.withColumn("p", p).collect():
        assert r.p == pytest.approx(plain.signed_rank_normal(r.v, r.n, r.ties), rel=1e-9)


def test_wilcoxon_ties_and_zeros(spark):
    values = [0.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0, None, math.nan]
    df = spark.createDataFrame([("g", x) for x in values] + [("z", 0.0)], "g string, x double")
    got = {r["g"]: r for r in T.wilcoxon_signed_rank(df, ["g"], "x").collect()}
    assert (got["g"]["n"], got["g"]["v"]) == (6, 1.5 + 3.5 + 3.5 + 6)
    variance = 6 * 7 * 13 / 24 - (2 * (8 - 2)) / 48
    z = (14.5 - 10.5 - 0.5) / math.sqrt(variance)
    assert got["g"]["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert (got["z"]["n"], got["z"]["v"], got["z"]["p"]) == (0, None, None)


def test_t_test_edge_cases(spark):
    rows = [("one", 1.0), ("same", 2.0), ("same", 2.0), ("two", 1.0), ("two", 3.0)]
    got = {r["g"]: r for r in T.t_test_one_sample(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert got["one"]["t"] is None and got["same"]["p"] is None
    # one degree of freedom is the Cauchy distribution
    assert got["two"]["p"] == pytest.approx(1 - 2 * math.atan(2.0) / math.pi)


def test_t_probability_with_two_degrees(spark):
    df = spark.createDataFrame([(t,) for t in (0.0, 0.1, 1.0, 5.0, 40.0)], "t double")
    for r in df.withColumn("p", PV.t_p_value(F.col("t"), F.lit(2.0))).collect():
        assert r.p == pytest.approx(1 - r.t / math.sqrt(2 + r.t * r.t), rel=1e-11)


def test_t_probability_equals_the_continued_fraction(spark):
    cases = [(t, d) for t in (0.01, -0.7, 2.1, 9.0, 60.0) for d in (1.0, 2.5, 9.0, 40.0, 700.0, 10000.0)]
    df = spark.createDataFrame(cases, "t double, d double")
    for r in df.withColumn("p", PV.t_p_value(F.col("t"), F.col("d"))).collect():
        assert r.p == pytest.approx(plain.t_two_sided(r.t, r.d), rel=1e-8, abs=1e-300), (r.t, r.d)


def test_normal_quantiles_and_tails(spark):
    df = spark.createDataFrame([(p,) for p in (1e-6, 1e-4, 0.01, 0.074, 0.0751, 0.3, 0.5, 0.6, 0.925, 0.9999)], "p double")
    z = PV.normal_quantile(F.col("p"))
    for r in df.select("p", z.alias("z")).withColumn("back", PV.normal_upper(-F.col("z"))).collect():
        assert r.z == pytest.approx(plain._NORMAL.inv_cdf(r.p), rel=1e-14, abs=1e-15)
        assert r.back == pytest.approx(r.p, rel=1e-11)


def test_shapiro_equals_plain_python(spark):
    rng = random.Random(9)
    samples = [sorted(rng.choice([rng.gauss, rng.uniform])(0, 1) for _ in range(n)) for n in (3, 4, 5, 6, 7, 11, 12, 13, 30, 101, 1000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(samples)], "i int, x array<double>")
    for r in PV.with_shapiro(df, "x").collect():
        assert (r.w, r.p) == pytest.approx(plain.shapiro(samples[r.i]), rel=1e-9)


def test_shapiro_sizes(spark):
    rng = random.Random(3)
    rows = [("small", float(i)) for i in range(2)] + [("same", 1.0)] * 5
    rows += [("three", x) for x in (1.0, 2.0, 3.0)] + [("many", rng.gauss(0, 1)) for _ in range(5001)]
    rows += [("normal", rng.gauss(0, 1)) for _ in range(500)] + [("skewed", rng.expovariate(1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in T.shapiro_wilk(df, ["g"], "x").collect()}
    assert all(got[g]["w"] is None and got[g]["p"] is None for g in ("small", "same", "many"))
    assert got["three"]["w"] == pytest.approx(1.0) and got["three"]["p"] == pytest.approx(1.0, abs=1e-6)
    assert got["normal"]["p"] > 0.01 and got["skewed"]["p"] < 1e-10


def test_verdict(spark):
    rows = [("a", -2.0, True), ("b", 2.0, True), ("c", 2.0, False), ("d", None, None)]
    df = spark.createDataFrame(rows, "metric string, median double, significant boolean")
    assert [r["verdict"] for r in T.verdict(df).orderBy("metric").collect()] == ["REDUCTION", "INCREASE", None, None]
