"""Grouped statistics, outliers, comparisons and ranks against plain Python."""

import math
import random
import statistics as st

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import aggregates as A
from runlens.operators import compare as C
from runlens.operators import order_stats as OS
from runlens.operators import outliers as O
from runlens.operators import ranking as K
from runlens.operators import reshape as H

RUNS = (
    "results_set string, run_id string, benchmark string, variant string, energy_joules double, "
    "exec_time_sec double, power_watts double, cpu_usage_avg double, memory_usage_avg double"
)


def make_runs(spark, rows):
    full = []
    for i, (benchmark, variant, energy) in enumerate(rows):
        full.append((f"s{i % 3}", f"r{i}", benchmark, variant, energy, 2.0, energy, float(i % 5), None))
    return spark.createDataFrame(full, RUNS)


@pytest.fixture(scope="module")
def mixed(spark):
    """Two normal groups, a one-row group, a constant one, one all missing."""
    rng = random.Random(5)
    rows = [("a", "BASELINE", rng.lognormvariate(0, 3)) for _ in range(400)]
    rows += [("a", "G1", round(rng.uniform(0, 3), 1)) for _ in range(301)]
    rows += [("b", "BASELINE", 7.0), ("b", "G9", None), ("b", "G9", math.nan)]
    rows += [("c", "G1", 4.0)] * 20 + [("d", "BASELINE", 0.0), ("d", "G1", 5.0), (None, "G1", 2.0)]
    return make_runs(spark, rows), rows


@pytest.mark.parametrize("cells,limit,split", [(1, 1, 2), (16, 20, 3), (64, 1000, 1024)])
def test_exact_quantiles(mixed, cells, limit, split, monkeypatch):
    for name, value in (("STEPS", cells), ("LIMIT", limit), ("SPLIT", split)):
        monkeypatch.setattr(OS, name, value)
    df, rows = mixed
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = OS.exact_quantiles(df, ["benchmark", "variant"], ["energy_joules"], probs).collect()
    assert len(got) == len({(b, v) for b, v, _ in rows})
    for r in got:
        x = [e for b, v, e in rows if (b, v) == (r[0], r[1]) and e is not None and not math.isnan(e)]
        want = [None] * len(probs) if not x else np.quantile(x, probs).tolist()
        assert r[2:] == pytest.approx(want) if x else list(r[2:]) == want


def test_global_quantiles_and_empty_input(mixed):
    df, rows = mixed
    x = [e for _, _, e in rows if e is not None and not math.isnan(e)]
    got = OS.exact_quantiles(df, [], ["energy_joules"], [0.5]).first()[0]
    assert got == pytest.approx(st.median(x))
    none = OS.exact_quantiles(df.filter("false"), ["benchmark"], ["energy_joules"], [0.5])
    assert none.count() == 0
    spec = {"x": ("energy_joules", ("median",))}
    assert A.grouped_stats(df, [], spec).first()[0] == pytest.approx(st.median(x))
    empty = A.grouped_stats(df.filter("false"), [], spec).collect()
    assert [tuple(r) for r in empty] == [(None,)]


def test_value_buckets_keep_the_order(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308, math.inf, -math.inf, 1.0, 2.0, 4.0, 0.5]
    values += [math.nextafter(2.0**k, side) for k in (-1022, -3, 0, 1, 10, 52, 1000) for side in (0, math.inf)]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", OS.value_bucket(F.col("v")))
    found = sorted((r["v"], r["b"]) for r in frame.collect())
    assert all(x[1] <= y[1] for x, y in zip(found, found[1:]))


def test_a_hot_group_is_spread_over_buckets(spark):
    """One key with 90 % of the rows: no bucket of it holds more than a small share of its values."""
    rows = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("k"), F.col("id").cast("double").alias("v"))
    most = rows.where("k = 'hot'").groupBy(OS.value_bucket(F.col("v"))).count().agg(F.max("count")).first()[0]
    assert most <= 100
    got = {r["k"]: r[1] for r in OS.exact_quantiles(rows, ["k"], ["v"], [0.5]).collect()}
    assert got == {"cold": 49_995.0, "hot": 50_000.0}


def test_reports_read_the_runs_once(spark, mixed):
    """Jobs run while a report with quantiles is built, but none of them reads the runs again."""
    df, rows = mixed
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    runs = df.mapInArrow(count, df.schema)
    for report in (A.stats_by_variant, A.overall_stats, A.stats_by_benchmark_variant, A.data_quality, K.best_and_worst, K.top10_efficient):
        read.value = 0
        report(runs).collect()
        assert read.value == len(rows), report.__name__


def test_a_day_of_timestamps_is_cut_by_its_own_counts(spark, monkeypatch):
    """A million distinct times of one day lie in one coarse cell; no task sorts more than a thousandth of them."""
    seen = []

    def staged(df, name, put=OS.staged):
        out = put(df, name)
        if name == "cells":
            seen.append([r["d"] for r in out.where("d > 1").collect()])
        return out

    monkeypatch.setattr(OS, "staged", staged)
    start, step = 1_700_006_400.0, 0.0625
    times = spark.range(1_000_000).select((F.lit(start) + F.col("id") * step).alias("t"))
    got = OS.exact_quantiles(times, [], ["t"], [0.25, 0.5, 0.999]).first()
    assert list(got) == [start + step * 999_999 * p for p in (0.25, 0.5, 0.999)]
    assert max(seen[0]) > 100_000  # the fixed scale hardly parts them
    assert max(seen[-1]) <= OS.LIMIT == 1_000
    seen.clear()
    ranked = OS.value_positions(times.where("id % 20 = 0"), [], "t")
    assert ranked.where(F.col("before") * step * 20 + start != F.col("t")).count() == 0
    assert max(seen[-1]) <= OS.LIMIT


def test_moments_far_from_zero(spark):
    """Deviations are taken from each cell's base, so a large common part doesn't drown them."""
    x = [1e9 + i * 0.001 for i in range(5_000)] + [1e9 + 77.0] * 3
    df = spark.createDataFrame([(v,) for v in x], "v double")
    spec = {"v": ("v", ("n", "mean", "sd", "median", "min", "max", "skewness", "kurtosis"))}
    r = A.grouped_stats(df, [], spec).first()
    m = st.mean(x)
    s = math.sqrt(sum((v - m) ** 2 for v in x) / (len(x) - 1))
    assert (r["v_n"], r["v_min"], r["v_max"], r["v_median"]) == (len(x), min(x), max(x), st.median(x))
    assert r["v_mean"] == pytest.approx(m, rel=1e-15) and r["v_sd"] == pytest.approx(s, rel=1e-6)
    assert r["v_skewness"] == pytest.approx(sum((v - m) ** 3 for v in x) / (len(x) * s**3), rel=1e-4)
    assert r["v_kurtosis"] == pytest.approx(sum((v - m) ** 4 for v in x) / (len(x) * s**4) - 3, rel=1e-4)


def test_outliers_by_fences_equal_those_by_flags(mixed):
    df, _ = mixed
    flagged = O.flag_outliers(df)
    for report in (A.stats_by_benchmark_variant, A.data_quality, A.table7_quality_matrix):
        columns = [c for c in report(df).columns if "outlier" in c or c == "variant" or c == "benchmark"]
        both = [sorted((tuple(r) for r in report(x).select(columns).collect()), key=repr) for x in (df, flagged)]
        assert both[0] == both[1]


def test_columns_with_odd_names_and_labels(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a")], "`SYSTEM_POWER (Watts)` double, `k.1` string")
    got = A.describe_metric(df, {"SYSTEM_POWER (Watts)": "it's power"}, ["k.1"]).collect()
    assert [(r[0], r["metric"], r["n"], r["median"]) for r in got] == [("a", "it's power", 2, 2.0)]


def test_value_positions(mixed):
    df, rows = mixed
    got = OS.value_positions(df, ["benchmark"], "energy_joules").collect()
    for benchmark in ("a", "b", "c", "d", None):
        x = sorted(e for b, _, e in rows if b == benchmark and e is not None and not math.isnan(e))
        mine = sorted((r["energy_joules"], r["ties"], r["before"], r["distinct_before"]) for r in got if r["benchmark"] == benchmark)
        distinct = sorted(set(x))
        assert mine == [(v, x.count(v), x.index(v), i) for i, v in enumerate(distinct)]


def test_describe_metric(mixed):
    df, rows = mixed
    got = {
        (r["benchmark"], r["metric"]): r
        for r in A.describe_metric(df, ["energy_joules", "memory_usage_avg"], ["benchmark"]).collect()
    }
    x = [e for b, _, e in rows if b == "a"]
    m, s, n = st.mean(x), st.stdev(x), len(x)
    r = got["a", "energy_joules"]
    assert r["n"] == n and r["mean"] == pytest.approx(m) and r["sd"] == pytest.approx(s)
    assert r["skewness"] == pytest.approx(sum((v - m) ** 3 for v in x) / (n * s**3))
    assert r["kurtosis"] == pytest.approx(sum((v - m) ** 4 for v in x) / (n * s**4) - 3)
    assert r["iqr"] == pytest.approx(np.quantile(x, 0.75) - np.quantile(x, 0.25))
    constant = got["c", "energy_joules"]
    assert constant["cv"] == 0 and constant["skewness"] is None and constant["kurtosis"] is None
    single = got["b", "energy_joules"]
    assert single["n"] == 1 and single["sd"] is None and single["median"] == 7.0
    empty = got["a", "memory_usage_avg"]
    assert empty["n"] == 0 and all(empty[c] is None for c in A.DESCRIBE if c != "n")


def test_outlier_flags_keep_rows(mixed):
    df, rows = mixed
    flagged = O.flag_outliers(df).collect()
    assert len(flagged) == len(rows)
    x = [e for b, v, e in rows if (b, v) == ("a", "BASELINE")]
    q1, q3 = np.quantile(x, [0.25, 0.75])
    mine = [r for r in flagged if (r["benchmark"], r["variant"]) == ("a", "BASELINE")]
    for r in mine:
        e = r["energy_joules"]
        assert r["is_outlier_moderate"] == (e < q1 - 1.5 * (q3 - q1) or e > q3 + 1.5 * (q3 - q1))
    both = [e for b, _, e in rows if b == "a"]
    z = {r["run_id"]: r["energy_z_score"] for r in mine}
    assert z["r0"] == pytest.approx((rows[0][2] - st.mean(both)) / st.stdev(both))
    missing = [r for r in flagged if r["variant"] == "G9"]
    assert all(r["is_outlier_moderate"] is None and r["energy_z_score"] is None for r in missing)


def test_quality_counts_missing_and_flags(mixed):
    df, _ = mixed
    q = {(r["benchmark"], r["variant"]): r for r in A.data_quality(O.flag_outliers(df)).collect()}
    assert q["b", "G9"]["missing_energy"] == 2 and q["b", "G9"]["n_outliers_moderate"] == 0
    assert q["b", "G9"]["stability"] == "Highly Variable"
    assert q["c", "G1"]["stability"] == "Very Stable" and q["c", "G1"]["outlier_rate_pct"] == 0


def test_comparisons_with_zero_and_missing_baseline(mixed):
    df, _ = mixed
    pairs = A.stats_by_benchmark_variant(O.flag_outliers(df))
    got = {(r["benchmark"], r["variant"]): r for r in C.stats_vs_baseline(pairs).collect()}
    assert got["d", "G1"]["energy_pct_vs_baseline"] is None  # zero baseline
    assert got["c", "G1"]["baseline_energy_mean"] is None  # no baseline rows
    assert got["a", "BASELINE"]["energy_pct_vs_baseline"] == pytest.approx(0)
    paired = {r["benchmark"] for r in C.paired_delta(df).collect()}
    assert paired == {"a", "b", "d"}


def test_delta_ci_matches_row_by_row(spark):
    rng = random.Random(1)
    rows = [("a", v, rng.uniform(1, 9)) for v in ("BASELINE", "G9", "G12", "G1") for _ in range(15)]
    rows.append(("a", "G9", None))
    df = make_runs(spark, rows)
    got = {r["variant"]: r for r in C.delta_ci(df, ["G9", "G12"]).collect()}
    assert set(got) == {"G9", "G12"}
    base = st.mean(e for _, v, e in rows if v == "BASELINE")
    change = [(e - base) / base * 100 for _, v, e in rows if v == "G9" and e is not None]
    se = st.stdev(change) / math.sqrt(len(change) + 1)  # all rows count
    r = got["G9"]
    assert r["n"] == 16 and r["energy_mean"] == pytest.approx(st.mean(change))
    assert r["energy_se"] == pytest.approx(se)
    assert r["energy_ci_upper"] == pytest.approx(st.mean(change) + 1.96 * se)
    pooled = C.delta_ci(df, ["G9", "G12"], ["benchmark"], exclude=[("a", "G12")]).collect()
    assert len(pooled) == 1 and pooled[0]["energy_mean"] == pytest.approx(r["energy_mean"])


def test_best_variant_keeps_ties(spark):
    rows = [("a", "BASELINE", 4.0), ("a", "G1", 2.0), ("a", "G3", 2.0), ("a", "G9", 3.0), ("b", "BASELINE", 1.0)]
    df = make_runs(spark, rows)
    best = K.best_variant(df)
    assert {(r["variant"], r["pct_change"]) for r in best.collect()} == {("G1", -50.0), ("G3", -50.0)}
    worst = K.worst_variant(df)
    assert [r["variant"] for r in worst.collect()] == ["G9"]
    assert K.best_worst(best, worst).count() == 2


def test_matrices_have_stable_columns(spark):
    df = make_runs(spark, [("a", "BASELINE", 4.0), ("a", "G1", 2.0), ("b", "BASELINE", 1.0)])
    m = H.energy_matrix(df, ["BASELINE", "G1", "G14"])
    assert m.columns == ["benchmark", "BASELINE", "G1", "G14"]
    assert {tuple(r) for r in m.collect()} == {("a", 4.0, 2.0, None), ("b", 1.0, None, None)}
    p = {r["benchmark"]: r["G1"] for r in H.pct_change_matrix(df, ["G1"]).collect()}
    assert p == {"a": -50.0, "b": None}


def test_top_and_order(spark):
    df = make_runs(spark, [(f"b{i}", "G1", float(i % 4)) for i in range(12)])
    top = K.top10_efficient(df, 5).orderBy("rank").collect()
    assert [r["benchmark"] for r in top] == ["b0", "b4", "b8", "b1", "b5"]
    low = K.top10_inefficient(df, 3).orderBy("rank").collect()
    assert [r["benchmark"] for r in low] == ["b11", "b3", "b7"]
    keys = {r["benchmark"]: r["sort_key"] for r in K.reorder_by_median(df, "benchmark", "energy_joules").collect()}
    assert keys["b0"] == 1 and keys["b5"] == 2 and keys["b11"] == 4


def test_reshape(spark):
    wide = spark.createDataFrame([("a", 1.0, None), ("b", math.inf, 2.0)], "benchmark string, delta_energy_pct double, delta_cpu_pct double")
    long = H.delta_long(wide)
    assert {(r["benchmark"], r["metric"]) for r in long.collect()} == {
        ("a", "Energy %"), ("a", "CPU %"), ("b", "Energy %"), ("b", "CPU %"),
    }
    nested = spark.createDataFrame([(1, [(1, "x"), (2, "y")]), (2, [])], "k int, s array<struct<a int, b string>>")
    assert H.unnest_struct(nested, "s").count() == 3
    kept, offending = O.exclude_extreme(
        spark.createDataFrame([("a", "G1", 5000.0), ("a", "G1", 5.0), ("a", "G3", None)], "benchmark string, variant string, delta_pct double")
    )
    assert kept.count() == 2 and [tuple(r) for r in offending.collect()] == [("a", "G1")]


def test_file_inventory_is_sorted_and_whole(spark):
    files = spark.createDataFrame([("e1", "b"), ("e1", "a"), ("e2", "z")], "experiment string, file string")
    assert [tuple(r) for r in A.file_inventory(files).select("experiment", "n_files", "file").collect()] == [
        ("e1", 2, "a"), ("e1", 2, "b"), ("e2", 1, "z"),
    ]


def test_before_after_and_flags(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert tuple(A.before_after_count(df, F.col("f")).first()) == (3, 1)
    assert tuple(A.count_flags(df, ["f"]).first()) == (3, 1)
