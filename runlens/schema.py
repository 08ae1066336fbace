"""Schemas and the fixed names of the experiment data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model -------------------------------------------
RUN_METRICS = [
    "total_energy_joules",
    "execution_time_seconds",
    "avg_power_watts",
    "max_power_watts",
    "min_power_watts",
    "cpu_usage_avg",
    "memory_usage_avg",
]
RUN_KEYS = ["__run_id", "python_file"]
BASELINE = "BASELINE"
OPTIMIZED = "OPTIMIZED"
EXCLUDED_VARIANTS = ["CLEAN", "ORIGINAL_FIXED"]
CODE_FAMILY = ["G1", "G3", "G4", "G6", "G7"]
PARALLEL_FAMILY = ["G9", "G12", "G14"]
ALL_GUIDELINES = ["G1", "G3", "G4", "G6", "G7", "G9", "G12", "G14"]
VARIANTS = [BASELINE, OPTIMIZED, *ALL_GUIDELINES]
LOG_PATTERN = r"Energy consumption in joules: ([0-9eE+.-]+) for ([0-9eE+.-]+) sec"
OVERALL_METRICS = {
    "energy_joules": "Energy (J)",
    "exec_time_sec": "Execution Time (s)",
    "power_watts": "Avg Power (W)",
    "cpu_usage_avg": "CPU Usage (%)",
    "memory_usage_avg": "Memory Usage (%)",
}
DELTA_METRICS = {
    "energy": "energy_joules",
    "time": "exec_time_sec",
    "cpu": "cpu_usage_avg",
    "memory": "memory_usage_avg",
    "power": "power_watts",
}
METRIC_LABELS = {
    "delta_energy_pct": "Energy %",
    "delta_time_pct": "Time %",
    "delta_cpu_pct": "CPU %",
    "delta_memory_pct": "Memory %",
    "delta_power_pct": "Power %",
    "energy_mean": "Energy %",
    "time_mean": "Time %",
    "cpu_mean": "CPU %",
    "memory_mean": "Memory %",
    "power_mean": "Power %",
}
# ---------------------------------------------------------------------------

# Run tables are read as text; numbers are converted afterwards so that one bad
# cell becomes a null and does not reject the row.
RUN_TABLE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in RUN_KEYS + RUN_METRICS]
)


def telemetry_schema(cores: int = 12, sensors: int = 8) -> T.StructType:
    """Wide sample rows: one column per core and per temperature sensor."""
    fields = [T.StructField("Delta", T.LongType()), T.StructField("Time", T.LongType())]
    fields += [T.StructField(f"CPU_FREQUENCY_{i}", T.LongType()) for i in range(cores)]
    fields += [T.StructField(f"CPU_TEMP_{i}", T.DoubleType()) for i in range(sensors)]
    fields += [T.StructField(f"CPU_USAGE_{i}", T.DoubleType()) for i in range(cores)]
    fields += [T.StructField("SYSTEM_POWER (Watts)", T.DoubleType())]
    fields += [
        T.StructField(name, T.LongType())
        for name in ("TOTAL_MEMORY", "TOTAL_SWAP", "USED_MEMORY", "USED_SWAP")
    ]
    return T.StructType(fields)
