"""Readers and writers on generated files, with the failure cases."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schema as S
from runlens.operators.aggregates import run_rollup, sample_measures
from runlens.sources import files as FS
from runlens.sources import logs as L
from runlens.sources import run_tables as R
from runlens.sources import sinks
from runlens.sources.telemetry import core_usage_long, scan_telemetry
from runlens.streaming.ingest import ingest_runs_incremental, sample_stream

HEADER = ",".join(S.RUN_KEYS + S.RUN_METRICS)


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture()
def root(tmp_path):
    base = str(tmp_path)
    write(f"{base}/results_1/main/run_table.csv", f"{HEADER}\nrun_0,km/km.py,1.5,0,2,3,1,50,40\nrun_1,km/km_G1.py,oops,2,,,,nan,41\n")
    write(f"{base}/results_2/main/run_table.csv", f"{HEADER}\nrun_0,km/km_CLEAN.py,9,9,9,9,9,9,9\nrun_1,solo.py,,,,,,,\n")
    line = "Energy consumption in joules: {} for {} sec of execution.\n"
    write(f"{base}/results_1/main/run_0/run.log", "noise\n" + line.format("4.0", "2.5"))
    write(f"{base}/results_1/main/run_1/run.log", line.format("1", "1") + "x\n" + line.format("8.0", "4.0"))
    write(f"{base}/results_2/main/run_1/run.log", "Traceback (most recent call last):\nSyntaxError: bad\n")
    return base


def test_run_tables_and_logs(spark, root):
    raw = R.scan_run_tables(spark, f"{root}/results_*/main/run_table.csv")
    logs = L.keyed_by_run(L.parse_run_log(spark, f"{root}/results_*/main/run_*/run.log"))
    runs = {(r["results_set"], r["run_id"]): r for r in R.clean_runs(raw, logs, root, "main").collect()}
    assert set(runs) == {("results_1", "run_0"), ("results_1", "run_1"), ("results_2", "run_1")}
    first, second, third = (runs[k] for k in sorted(runs))
    # a stored zero is kept as it is unless it is to be repaired
    assert (first["energy_joules"], first["exec_time_sec"], first["power_watts"]) == (1.5, 0.0, 2.0)
    assert (second["variant"], second["energy_joules"], second["power_watts"]) == ("G1", 8.0, 4.0)
    assert second["cpu_usage_avg"] is None and second["log_path"].endswith("results_1/main/run_1/run.log")
    assert (third["benchmark"], third["energy_joules"], third["power_watts"]) == ("solo", None, None)
    repaired = R.clean_runs(raw, logs, root, "main", repair_zero=True)
    assert repaired.filter("run_id = 'run_0' and results_set = 'results_1'").first()["exec_time_sec"] == 2.5


def test_quarantine(spark, tmp_path):
    base = str(tmp_path)
    whole = "run_{},a/a.py,1,2,3,4,5,6,7\n"
    write(f"{base}/good.csv", f"{HEADER}\n" + whole.format(0))
    write(f"{base}/deep/bad.csv", f"{HEADER}\n{whole.format(1)}run_2,a/a.py,1\n{whole.format(3)}x,y,1,2,3,4,5,6,7,8,9\n")
    write(f"{base}/header.csv", f"{HEADER}\n")
    packed = gzip.compress("".join([f"{HEADER}\n"] + [whole.format(random.random()) for _ in range(20_000)]).encode())
    with open(f"{base}/cut.csv.gz", "wb") as f:
        f.write(packed[:20])
    got = R.scan_quarantine(spark, base, S.RUN_TABLE_SCHEMA).collect()
    bad = [(os.path.basename(r["path"]), r["line"]) for r in got if r["reason"] == "malformed line"]
    assert sorted(bad) == [("bad.csv", "run_2,a/a.py,1"), ("bad.csv", "x,y,1,2,3,4,5,6,7,8,9")]
    files = {os.path.basename(r["path"]) for r in got if r["reason"] == "no rows"}
    assert files == {"header.csv", "cut.csv.gz"} and len(got) == 4
    # the tolerant scan keeps the lines that the quarantine names, as far as they go
    assert R.scan_tolerant(spark, base, S.RUN_TABLE_SCHEMA).count() == 5


def test_log_parsers(spark, root):
    pattern = f"{root}/results_*/main/run_*/run.log"
    by_regex = L.parse_run_log(spark, pattern)
    assert by_regex.filter("failed").count() == 1
    keyword = L.parse_run_log_keyword(spark, pattern)
    assert sorted(map(repr, by_regex.collect())) == sorted(map(repr, keyword.collect()))
    bad = spark.createDataFrame(
        [("p", 1, "Energy consumption in joules: 5.0 for 2.0 sec of execution."),
         ("p", 2, "Energy consumption in joules: 1.2.3 for 7 sec of execution."),
         ("q", 1, "")],
        "path string, place int, line string",
    )
    got = {r["path"]: (r[1], r[2]) for r in L.last_reading(bad).collect()}
    assert got == {"p": (None, 7.0), "q": (None, None)}


def test_clean_runs_finds_names_once(spark, root):
    """The plan of the cleaned runs doesn't grow by a copy of the names for every use."""
    raw = R.scan_run_tables(spark, f"{root}/results_*/main/run_table.csv")
    plan = R.clean_runs(raw, root=root, subdir="main").select("run_id", "benchmark", "variant")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    assert not any(".py" in line for line in plan.splitlines() if "Filter" in line)


def test_log_bundles(spark, tmp_path):
    """Many logs in few files, as one log a file would give; a log may go on in the next file."""
    summary = "Energy consumption in joules: {}.5 for 2.0 sec of execution."
    logs = {f"run={k}": ["sampling started", summary.format(k), "a\ttab", summary.format(k + 100)] for k in range(5)}
    logs["run=3"].append("Traceback (most recent call last)")
    logs["run="] = [""]
    for name, lines in logs.items():
        write(f"{tmp_path}/single/{name}/run.log", "\n".join(lines) + "\n")
    tagged = [f"{name}\t{line}" for name, lines in logs.items() for line in lines]
    write(f"{tmp_path}/bundles/part-0", "\n".join(tagged[:7]) + "\n")
    write(f"{tmp_path}/bundles/part-1", "\n".join(["no log", *tagged[7:]]) + "\n")
    for parse in (L.parse_run_log, L.parse_run_log_keyword):
        got = {r["path"]: tuple(r)[1:] for r in parse(spark, f"{tmp_path}/bundles", L.scan_log_bundles).collect()}
        assert got == {r["path"].split("/")[-2]: tuple(r)[1:] for r in parse(spark, f"{tmp_path}/single").collect()}
        assert got["run=3"] == (103.5, 2.0, True) and got["run="] == (None, None, False) and len(got) == 6


def test_log_queries_write_few_files(spark, tmp_path):
    """As many files as tasks, whatever the number of logs; a log without a number is kept."""
    import glob

    from runlens.plans import experiment_queries as Q

    items = spark.range(900).selectExpr(
        "nullif(id % 300, 0) AS l_suppkey", "id AS l_orderkey", "1 + id % 7 AS l_linenumber",
        "CAST(id AS DOUBLE) AS l_extendedprice", "2.0D AS l_quantity", "0.0D AS l_tax",
    )
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    written = Q._log_files(spark, str(tmp_path))
    assert len(glob.glob(f"{written}/**/*.txt", recursive=True)) <= 8
    rows = Q.parse_run_log(spark, str(tmp_path)).collect()
    assert {r["run"] for r in rows} == {None, *range(1, 300)} and len(rows) == 300


def test_tolerant_scan(spark, root):
    write(f"{root}/results_3/main/run_table.csv", f"{HEADER}\nrun_0,km/km.py,1\n")
    write(f"{root}/results_4/main/run_table.csv", "")
    raw = R.scan_run_tables(spark, f"{root}/results_*/main/run_table.csv")
    assert raw.count() == 5
    assert raw.filter("results_set = 'results_3'").first()["avg_power_watts"] is None
    with pytest.raises(ValueError, match="python_file"):
        R.require_columns(raw.drop("python_file"))


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, 5.0)], "k int, b double")
    assert {tuple(r) for r in R.union_by_name(a, b).collect()} == {(1, "x", None), (2, None, 5.0)}


def test_telemetry_rollup(spark, tmp_path):
    schema = S.telemetry_schema(cores=2, sensors=1)
    names = ",".join(schema.names)
    # Delta, Time, frequencies, temperature, usages, power, memory and swap
    write(f"{tmp_path}/a.csv", f"{names}\n0,1000,1,1,50,10,20,5.0,200,0,50,0\n200,1200,1,1,50,NaN,40,7.0,200,0,100,0\n")
    write(f"{tmp_path}/b.csv", f"{names}\n0,1000,1,1,50,NaN,NaN,NaN,0,0,50,0\n")
    samples = scan_telemetry(spark, str(tmp_path), schema)
    got = {os.path.basename(r["path"]): r for r in run_rollup(samples, ["path"]).collect()}
    a, b = got["a.csv"], got["b.csv"]
    assert (a["avg_power_watts"], a["max_power_watts"], a["min_power_watts"]) == (6.0, 7.0, 5.0)
    assert a["cpu_usage_avg"] == (15.0 + 40.0) / 2 and a["memory_usage_avg"] == 37.5
    assert (b["n_samples"], b["avg_power_watts"], b["cpu_usage_avg"], b["memory_usage_avg"]) == (1, None, None, None)
    assert core_usage_long(samples, ["path", "Time"]).count() == 6
    assert samples.schema["event_time"].dataType == T.TimestampType()


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    schema = S.telemetry_schema(cores=2, sensors=1)
    names = ",".join(schema.names)
    row = "0,1000,1,1,50,10,{},{},200,0,50,0\n"
    source = f"{tmp_path}/in"

    def ingest():
        stream = sample_stream(spark, source, schema, "csv", files_per_batch=1, header=True)
        keyed = stream.withColumn("run", F.col("Delta"))
        return ingest_runs_incremental(keyed, ["run"], sample_measures(keyed), f"{tmp_path}/out", f"{tmp_path}/state")

    os.makedirs(source, exist_ok=True)
    assert ingest().count() == 0  # nothing has arrived
    write(f"{source}/a.csv", names + "\n" + row.format(20, 5.0))
    write(f"{source}/b.csv", names + "\n" + row.format(40, "NaN"))
    assert ingest().count() == 1
    write(f"{source}/c.csv", names + "\n" + row.format(60, 9.0))
    got = ingest().first()
    batch = spark.read.schema(schema).option("header", True).csv(source).withColumn("run", F.col("Delta"))
    want = run_rollup(batch, ["run"]).first()
    assert got["n_samples"] == 3 and got.asDict() == want.asDict()


def test_labelled_csv_and_splits(spark, tmp_path):
    write(f"{tmp_path}/l/x.csv", "1,M,1.0,2.0\n2,B,3.0,\n3,B,5.0,6.0\n")
    df = R.scan_labelled_csv(spark, f"{tmp_path}/l", ["id", "y", "a", "b"], "y", "id")
    assert sorted(tuple(r) for r in df.collect()) == [(-1, 5.0, 6.0), (1, 1.0, 2.0)]
    rows = spark.range(1000).selectExpr("id * 3 AS k")
    train, test = R.positional_split(rows, 328, "k")
    assert train.count() == 328 and test.count() == 672 and train.agg(F.max("k")).first()[0] == 327 * 3
    left, right = R.hash_split(rows, 30, "k")
    assert left.count() + right.count() == 1000 and 200 < left.count() < 400
    everything, nothing = R.positional_split(rows, 5000, "k")
    assert everything.count() == 1000 and nothing.count() == 0


def test_listing_and_sinks(spark, root, tmp_path):
    found = FS.discover_files(spark, root, "*.csv", exclude="results_2")
    assert [os.path.basename(r["path"]) for r in found.collect()] == ["run_table.csv"]
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "benchmark string, x double")
    out = sinks.write_outputs({"t": df}, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(out["t"]).count() == 2
    kept = sinks.materialise_clean(df, f"{tmp_path}/clean")
    assert sorted(tuple(r) for r in kept.select("benchmark", "x").collect()) == [("a", 1.0), ("b", 2.0)]
    plan = kept.filter("benchmark = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(benchmark" in plan


def test_a_log_may_be_split(spark, tmp_path):
    """Many parts of one file: the last summary is still the last line's."""
    line = "Energy consumption in joules: {} for {} sec of execution."
    lines = [line.format(i, i / 2) if i % 7 == 0 else "noise " * (i % 5) for i in range(2000)]
    write(f"{tmp_path}/one/run.log", "\n".join(lines) + "\n")
    write(f"{tmp_path}/two/run.log", "noise\nValueError: no summary here\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        scanned = L.parse_run_log(spark, str(tmp_path))
        assert scanned.count() == 2
        got = {r["path"].split("/")[-2]: (r["energy_joules_log"], r["exec_time_sec_log"], r["failed"]) for r in scanned.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"one": (1995.0, 997.5, False), "two": (None, None, True)}
