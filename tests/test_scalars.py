"""Column expressions on small frames with the awkward cases."""

import math

from pyspark.sql import functions as F

from runlens.functions import scalars as P


def test_parse_variant(spark):
    paths = [
        ("bench/bench_G1.py", "bench", "G1"),
        ("bench/bench.py", "bench", "BASELINE"),
        ("solo.py", "solo", "BASELINE"),
        ("a/b/b_OPTIMIZED.py", "b", "OPTIMIZED"),
        ("b.x/other.py", "b.x", "BASELINE"),
        ("b.x/b.x_G2.py", "b.x", "G2"),
        ("b.x/bax_G2.py", "b.x", "BASELINE"),
        (None, None, None),
    ]
    df = spark.createDataFrame([(p,) for p, _, _ in paths], "p string")
    got = df.select("p", *[c.alias(n) for n, c in P.parse_variant("p").items()]).collect()
    assert {tuple(r) for r in got} == set(paths)


def test_safe_numeric_and_finite(spark):
    df = spark.createDataFrame([("1.5",), ("bad",), ("",), (None,), ("NaN",), ("1e3",), ("Infinity",)], "t string")
    got = [r[0] for r in df.select(P.safe_numeric("t").alias("x")).collect()]
    assert got == [1.5, None, None, None, None, 1000.0, math.inf]
    assert P.finite_only(df.select(P.safe_numeric("t").alias("x")), "x").count() == 2


def test_pct_change_zero_base_is_null(spark):
    df = spark.createDataFrame([(5.0, 4.0), (5.0, 0.0), (None, 4.0)], "x double, b double")
    assert [r[0] for r in df.select(P.pct_change("x", "b")).collect()] == [25.0, None, None]


def test_coalesce_sources_and_power(spark):
    df = spark.createDataFrame(
        [(0.0, 3.0, None), (None, 3.0, None), (2.0, 3.0, 9.0)], "a double, log double, w double"
    )
    got = df.select(
        P.coalesce_sources("a", "log").alias("kept"),
        P.coalesce_sources("a", "log", repair_zero=True).alias("fixed"),
        P.derive_power("w", F.lit(6.0), "a").alias("power"),
    ).collect()
    assert [tuple(r) for r in got] == [(0.0, 3.0, None), (3.0, 3.0, None), (2.0, 2.0, 9.0)]


def test_labels_with_null(spark):
    df = spark.createDataFrame([(4.9,), (9.0,), (19.0,), (29.0,), (31.0,), (None,)], "cv double")
    got = df.select(P.stability_5("cv"), P.stability_4("cv"), P.significance_label(F.col("cv") / 1000)).collect()
    assert [r[0] for r in got] == [
        "Very Stable", "Stable", "Moderate", "Variable", "Highly Variable", "Highly Variable",
    ]
    assert [r[1] for r in got] == ["Stable", "Stable", "Moderate", "Variable", "High Var", "High Var"]
    assert [r[2] for r in got] == ["**", "**", "*", "*", "*", "ns"]


def test_winsorize_and_interval(spark):
    df = spark.createDataFrame([(150.4,), (-300.0,), (7.0,), (None,)], "x double")
    got = df.select(*[c.alias(n) for n, c in P.winsorize("x", 100).items()]).collect()
    assert [r["display_value"] for r in got] == [100.0, -100.0, 7.0, None]
    assert [r["label_text"] for r in got] == ["+150%", "-300%", "", ""]
    assert [r["label_y"] for r in got] == [92.0, -92.0, None, None]
    low, high = P.clamp_interval("x", "x", 100)
    assert [tuple(r) for r in df.select(low, high).collect()] == [
        (150.4, 100.0), (-100.0, -300.0), (7.0, 7.0), (None, None),
    ]


def test_exclusions_keep_null_keys(spark):
    df = spark.createDataFrame([("b", "G1"), ("b", "CLEAN"), ("c", None), (None, "G1")], "benchmark string, variant string")
    assert P.exclude_variants(df).count() == 3
    assert P.exclude_pair(df, [("b", "G1")]).count() == 3


def test_row_mean_skips_missing_cells(spark):
    df = spark.createDataFrame(
        [(1.0, 3.0), (math.nan, 3.0), (None, math.nan)], "CPU_USAGE_0 double, CPU_USAGE_1 double"
    )
    assert [r[0] for r in df.select(P.row_mean(df, "CPU_USAGE_")).collect()] == [2.0, 3.0, None]
    assert df.select(P.row_mean(df, "GPU_")).first()[0] is None


def test_names_and_report_text(spark):
    df = spark.createDataFrame([("delta_energy_pct_q25", 1.234), ("plain", None)], "s string, x double")
    got = df.select(
        *P.split_last_token("s").values(), P.fixed("x", 1, sign=True), P.span("x", "x"), P.percent_text("x")
    ).collect()
    assert tuple(got[0]) == ("delta_energy_pct", "q25", "+1.2", "1.23 - 1.23", "+1.2%")
    assert tuple(got[1]) == ("plain", None, None, None, None)
    labels = df.select(P.metric_label(F.lit("delta_cpu_pct")), P.metric_label("s")).first()
    assert tuple(labels) == ("CPU %", "delta_energy_pct_q25")


def test_names_by_plain_searches(spark):
    """The same names as by patterns and splits, which a plan repeats for every use of a column."""
    import re

    texts = [None, "", "a", "a.py", "b/b_G1.py", "x/b/b_G9.py", "/c.py", "b/", "b/b_.py", "a.pyc", "b/x.py/b_G3", "b/b_G1.py\n", "k=v/b.py"]
    rows = spark.createDataFrame([(t,) for t in texts], "p string")
    found = rows.select("p", *[c.alias(n) for n, c in P.parse_variant("p").items()])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 0
    for r in found.collect():
        if r["p"] is None:
            assert (r["benchmark"], r["variant"]) == (None, None)
            continue
        parts = re.sub(r"\.py$", "", r["p"]).split("/")
        benchmark = parts[-2] if len(parts) > 1 else parts[-1]
        marked = parts[-1] != benchmark and parts[-1].startswith(benchmark + "_")
        assert (r["benchmark"], r["variant"]) == (benchmark, parts[-1][len(benchmark) + 1 :] if marked else "BASELINE")
