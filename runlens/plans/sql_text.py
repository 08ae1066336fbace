"""Building blocks of the SQL twins."""

from __future__ import annotations

from runlens import schema as S
from runlens.functions import pvalues as PV
from runlens.plans.driver_tables import VARIANT_OF_LINE

_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in VARIANT_OF_LINE.items())

RUNS = f"""WITH runs AS (
  SELECT 'results_' || month(l_shipdate) AS results_set,
         'run_' || l_orderkey || '_' || l_linenumber AS run_id,
         'b' || (l_suppkey % 10) AS benchmark,
         CASE l_linenumber {_CASES} END AS variant,
         l_extendedprice AS energy_joules,
         l_quantity AS exec_time_sec,
         l_extendedprice / l_quantity AS power_watts,
         nullif(l_discount, 0) * 100 AS cpu_usage_avg,
         l_tax * 100 AS memory_usage_avg
  FROM lineitem)
"""

def draw(*parts: str) -> str:
    """A uniform number between 0 and 1 from the md5 of the parts, as `scalars.draw` makes it."""
    text = " || '|' || ".join(parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / pow(2, 52)"


# prices are even and have no outliers; power is skewed and has some
FLAGGED = RUNS + """, skewed AS (SELECT * REPLACE (power_watts AS energy_joules) FROM runs),
fences AS (
  SELECT benchmark, variant, quantile_cont(energy_joules, 0.25) AS q1, quantile_cont(energy_joules, 0.75) AS q3
  FROM skewed GROUP BY benchmark, variant),
centre AS (
  SELECT benchmark, avg(energy_joules) AS m, stddev_samp(energy_joules) AS s FROM skewed GROUP BY benchmark),
flagged AS (
  SELECT r.*,
         energy_joules < q1 - 1.5 * (q3 - q1) OR energy_joules > q3 + 1.5 * (q3 - q1) AS is_outlier_moderate,
         energy_joules < q1 - 3 * (q3 - q1) OR energy_joules > q3 + 3 * (q3 - q1) AS is_outlier_extreme,
         (energy_joules - m) / nullif(s, 0) AS energy_z_score,
         abs((energy_joules - m) / nullif(s, 0)) > 2.5 AS is_outlier_zscore,
         abs((energy_joules - m) / nullif(s, 0)) > 3 AS is_outlier_extreme_zscore
  FROM skewed r JOIN fences f ON r.benchmark = f.benchmark AND r.variant = f.variant
  JOIN centre c ON r.benchmark = c.benchmark)
"""

_MEASURE = {
    "mean": "avg({c})",
    "median": "quantile_cont({c}, 0.5)",
    "sd": "stddev_samp({c})",
    "variance": "var_samp({c})",
    "min": "min({c})",
    "max": "max({c})",
    "q25": "quantile_cont({c}, 0.25)",
    "q75": "quantile_cont({c}, 0.75)",
    "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)",
    "cv": "stddev_samp({c}) / nullif(avg({c}), 0) * 100",
}
COLUMN = {
    "energy": "energy_joules",
    "time": "exec_time_sec",
    "power": "power_watts",
    "cpu": "cpu_usage_avg",
    "memory": "memory_usage_avg",
}


def measures(prefix: str, names: str, column: str | None = None) -> str:
    c = column or COLUMN[prefix]
    return ", ".join(f"{_MEASURE[m].format(c=c)} AS {prefix}_{m}" for m in names.split())


def stats(source: str, keys: str, select: str, where: str = "") -> str:
    """A grouped SELECT over the runs."""
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"SELECT {head}{select} FROM {source} {where} {group}"


FULL = "mean median sd variance min max q25 q75 iqr cv"
SHORT = "mean median sd min max"
CENTER = "mean median sd"
WITH_VARIANCE = "mean median sd variance"


def names(prefix: str, which: str) -> str:
    """Output list entries; variances are large and keep no decimals."""
    return " ".join(f"{prefix}_{m}" + (":0" if m == "variance" else "") for m in which.split())


PAIR_STATS = FLAGGED + ", pair_stats AS (" + stats(
    "flagged",
    "benchmark, variant",
    ", ".join(
        [
            "count(*) AS n_runs",
            measures("energy", FULL),
            *[measures(p, WITH_VARIANCE) for p in ("time", "power", "cpu", "memory")],
            "count(*) FILTER (WHERE is_outlier_moderate) AS n_outliers_moderate",
            "count(*) FILTER (WHERE is_outlier_extreme) AS n_outliers_extreme",
            "count(*) FILTER (WHERE is_outlier_moderate) * 100.0 / count(*) AS outlier_rate",
        ]
    ),
) + ")\n"

PERFORMANCE = RUNS + """, medians AS (
  SELECT benchmark, variant, quantile_cont(energy_joules, 0.5) AS median_energy, avg(energy_joules) AS mean_energy
  FROM runs GROUP BY benchmark, variant),
base AS (SELECT benchmark, median_energy AS baseline_median FROM medians WHERE variant = 'BASELINE'),
performance AS (
  SELECT m.*, b.baseline_median,
         (median_energy - baseline_median) / nullif(baseline_median, 0) * 100 AS pct_change
  FROM medians m LEFT JOIN base b ON m.benchmark = b.benchmark)
"""

DELTA = RUNS + ", delta AS (SELECT benchmark, " + ", ".join(
    f"avg(CASE WHEN variant = '{v}' THEN {c} END) AS {side}_{n}"
    for n, c in S.DELTA_METRICS.items()
    for side, v in (("baseline", "BASELINE"), ("opt", "OPTIMIZED"))
) + """ FROM runs GROUP BY benchmark HAVING count(*) FILTER (WHERE variant = 'BASELINE') > 0),
paired AS (SELECT *, """ + ", ".join(
    f"(opt_{n} - baseline_{n}) / nullif(baseline_{n}, 0) * 100 AS delta_{n}_pct" for n in S.DELTA_METRICS
) + " FROM delta),\ndelta_long AS (" + " UNION ALL ".join(
    f"SELECT benchmark, '{S.METRIC_LABELS[f'delta_{n}_pct']}' AS metric, delta_{n}_pct AS delta_pct FROM paired"
    for n in S.DELTA_METRICS
) + ")\n"


def delta_ci(variants: list[str], by: str, where: str = "") -> str:
    """Per-run changes, then mean, standard error and interval, step by step."""
    listed = ", ".join(f"'{v}'" for v in variants)
    base = ", ".join(f"avg({c}) AS b_{n}" for n, c in S.DELTA_METRICS.items())
    change = ", ".join(f"({c} - b_{n}) / nullif(b_{n}, 0) * 100 AS d_{n}" for n, c in S.DELTA_METRICS.items())
    agg = ", ".join(
        f"avg(d_{n}) AS {n}_mean, stddev_samp(d_{n}) / sqrt(count(*)) AS {n}_se" for n in S.DELTA_METRICS
    )
    ci = ", ".join(
        f"{n}_mean - 1.96 * {n}_se AS {n}_ci_lower, {n}_mean + 1.96 * {n}_se AS {n}_ci_upper"
        for n in S.DELTA_METRICS
    )
    return f"""{RUNS}, base AS (
  SELECT benchmark, {base} FROM runs WHERE variant = 'BASELINE' GROUP BY benchmark),
changes AS (
  SELECT r.benchmark, r.variant, {change} FROM runs r LEFT JOIN base b ON r.benchmark = b.benchmark
  WHERE r.variant IN ({listed}) {where}),
grouped AS (SELECT {by}, count(*) AS n, {agg} FROM changes GROUP BY {by}),
ci AS (SELECT *, {ci} FROM grouped)
"""


def families(pairs: list[tuple[str, str]]) -> str:
    """Treatment rows per benchmark and repetition, and their slope statistics."""
    rows = " UNION ALL ".join(
        f"SELECT benchmark, results_set, avg(energy_joules) AS energy_joules, '{label}' AS treatment "
        f"FROM runs WHERE {where} GROUP BY benchmark, results_set"
        for label, where in pairs
    )
    return f"""{RUNS}, treated AS ({rows}),
slopes AS (
  SELECT benchmark, treatment, avg(energy_joules) AS energy_mean,
         stddev_samp(energy_joules) / sqrt(count(*)) AS energy_se
  FROM treated GROUP BY benchmark, treatment)
"""


CODE = ("CODE_OPTIMIZATION", "variant IN ('G1', 'G3', 'G4', 'G6', 'G7')")
PARALLEL = (
    "MULTITHREADING",
    "variant IN ('G9', 'G12', 'G14') AND NOT (benchmark = 'b1' AND variant = 'G12')",
)
TREATMENTS = families([CODE, PARALLEL])

TELEMETRY = """WITH samples AS (
  SELECT user_id, ts, value AS power,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, event_type
  FROM events),
measured AS (
  SELECT user_id, ts, power,
         CASE WHEN event_type = 'error' THEN k ELSE (k + k / 2) / 2 END AS cpu_pct,
         k / (100 + user_id % 50) * 100 AS mem_pct
  FROM samples)
"""
ROLLUP = TELEMETRY + """SELECT user_id, count(*) AS n_samples, avg(power) AS avg_power_watts,
  max(power) AS max_power_watts, min(power) AS min_power_watts,
  avg(cpu_pct) AS cpu_usage_avg, avg(mem_pct) AS memory_usage_avg
FROM measured GROUP BY user_id"""

LOG_LINES = """WITH lines AS (
  SELECT l_suppkey AS run, (l_orderkey, l_linenumber) AS n, l_extendedprice AS e, l_quantity AS q,
         l_linenumber % 3 <> 0 AND l_suppkey % 10 <> 7 AS summary, l_tax > 0.07 AND l_suppkey % 3 = 1 AS broken
  FROM lineitem),
logs AS (
  SELECT run, arg_max(e, (n, e, q)) FILTER (WHERE summary) AS energy_joules_log,
         arg_max(q, (n, e, q)) FILTER (WHERE summary) AS exec_time_sec_log,
         bool_or(broken AND NOT summary) AS failed
  FROM lines GROUP BY run)
"""


# -- probabilities of the tests ---------------------------------------------
def polynomial(coefficients, x: str) -> str:
    out = repr(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"({out} * {x} + {c!r})"
    return out


def integral(log_density: str, scale: str) -> str:
    """The trapezoid rule of `pvalues.integral`; the density names its argument ``{w}``."""
    x = f"(k / {PV.STEPS}e0)"
    w = f"(({scale}) * exp(pi() / 2 * sinh({x})))"
    nodes = f"range({PV.FIRST * PV.STEPS}, {PV.LAST * PV.STEPS + 1})"
    return f"(list_sum([exp({log_density.format(w=w)}) * {w} * cosh({x}) FOR k IN {nodes}]) * pi() / 2 / {PV.STEPS})"


def normal_upper(z: str) -> str:
    tail = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * " + integral(f"-abs({z}) * {{w}} - {{w}} * {{w}} / 2", f"1 / (abs({z}) + 1)") + ")"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END"


def normal_quantile(p: str) -> str:
    q, tail = f"(({p}) - 0.5)", f"(sqrt(-ln(least({p}, 1 - ({p})))) - 1.6)"
    middle = f"(0.180625 - {q} * {q})"
    return (
        f"CASE WHEN abs{q} <= 0.425 THEN {q} * {polynomial(PV.MIDDLE_TOP, middle)} / {polynomial(PV.MIDDLE_BOTTOM, middle)} "
        f"ELSE sign{q} * {polynomial(PV.TAIL_TOP, tail)} / {polynomial(PV.TAIL_BOTTOM, tail)} END"
    )


def t_test(source: str, by: str, x: str, mu: float = 0.0) -> str:
    """CTE ``t_tests``: (by, n, t, df, p)."""
    density = "-df * ln(1 + 2 * pow(sinh(least({w}, 700) / 2), 2) + slope * sinh(least({w}, 700)))"
    return f"""t_base AS (SELECT {by}, count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) / sqrt(count({x})) AS se FROM {source} GROUP BY {by}),
t_stat AS (SELECT {by}, n, CASE WHEN n >= 2 AND se > 10 * 2.220446049250313e-16 * abs(mean) THEN (mean - {mu}) / se END AS t,
  CASE WHEN n >= 2 AND se > 10 * 2.220446049250313e-16 * abs(mean) THEN CAST(n - 1 AS DOUBLE) END AS df FROM t_base),
t_sloped AS (SELECT *, abs(t) / sqrt(df + t * t) AS slope FROM t_stat),
t_tests AS (SELECT {by}, n, t, df, CASE WHEN t IS NOT NULL THEN least(1, 2 / sqrt(pi()) * exp(lgamma((df + 1) / 2) - lgamma(df / 2))
  * exp(-df / 2 * ln(1 + t * t / df)) * {integral(density, "1 / (df * slope + sqrt(df))")}) END AS p FROM t_sloped)"""


def signed_rank(source: str, by: str, x: str, mu: float = 0.0) -> str:
    """CTE ``rank_tests``: (by, n, v, p); needs WITH RECURSIVE."""
    sums = (PV.EXACT_BELOW - 1) * PV.EXACT_BELOW // 2 + 1
    z = "abs(v - n * (n + 1) / 4e0 - sign(v - n * (n + 1) / 4e0) * 0.5) / sqrt(variance)"
    return f"""ways(n, w) AS (SELECT CAST(0 AS BIGINT), [CASE WHEN i = 0 THEN 1e0 ELSE 0e0 END FOR i IN range({sums})]
  UNION ALL SELECT n + 1, [w[i + 1] + CASE WHEN i > n THEN w[i - n] ELSE 0e0 END FOR i IN range({sums})] FROM ways WHERE n < {PV.EXACT_BELOW - 1}),
diffs AS (SELECT {by}, {x} - {mu} AS d FROM {source}),
sized AS (SELECT {by}, abs(d) AS size, count(*) AS ties, count(*) FILTER (WHERE d > 0) AS up FROM diffs WHERE d <> 0 GROUP BY ALL),
ranked AS (SELECT *, sum(ties) OVER (PARTITION BY {by} ORDER BY size) - ties + (ties + 1) / 2e0 AS r FROM sized),
rank_stats AS (SELECT {by}, CAST(sum(ties) AS BIGINT) AS n, CAST(sum(up * r) AS DOUBLE) AS v,
  sum(CAST(ties AS DOUBLE) * ties * ties - ties) AS tie_sum FROM ranked GROUP BY {by}),
rank_zeros AS (SELECT {by}, count(*) FILTER (WHERE d = 0) AS zeros FROM diffs GROUP BY {by}),
rank_cases AS (SELECT {by}, coalesce(n, 0) AS n, v, tie_sum = 0 AND zeros = 0 AND n < {PV.EXACT_BELOW} AS exact,
  nullif(greatest(0, CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48), 0) AS variance
  FROM rank_zeros LEFT JOIN rank_stats USING ({by})),
rank_tests AS (SELECT {by}, c.n, v, CASE WHEN v IS NULL THEN NULL
  WHEN exact THEN least(1, 2 * least(list_sum(w[1:CAST(v AS BIGINT) + 1]), list_sum(w[CAST(v AS BIGINT) + 1:])) / pow(2, c.n))
  ELSE least(1, 2 * ({normal_upper("z")})) END AS p
  FROM (SELECT *, {z} AS z FROM rank_cases) c LEFT JOIN ways ON ways.n = c.n)"""


def shapiro(source: str, by: str, x: str) -> str:
    """CTE ``normality``: (by, n, w, p)."""
    u, size, ln = "(1 / sqrt(n))", "CAST(n AS DOUBLE)", "ln(n)"
    gamma = polynomial(PV.SMALL_GAMMA, size)
    small = f"(-ln({gamma} - ln(1 - w)) - {polynomial(PV.SMALL_MEAN, size)}) / exp({polynomial(PV.SMALL_LOG_SD, size)})"
    large = f"(ln(1 - w) - {polynomial(PV.LARGE_MEAN, ln)}) / exp({polynomial(PV.LARGE_LOG_SD, ln)})"
    keys = ", ".join(f"o.{k.strip()}" for k in by.split(","))
    return f"""n_ordered AS (SELECT {by}, {x} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {x}) AS r,
  count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {x} IS NOT NULL),
n_scored AS (SELECT *, {normal_quantile("(r - 0.375e0) / (n + 0.25e0)")} AS m FROM n_ordered WHERE n BETWEEN 3 AND 5000),
n_norm AS (SELECT {by}, n, sum(m * m) AS norm, max(m) FILTER (WHERE r = n) AS m1,
  CASE WHEN n > 5 THEN max(m) FILTER (WHERE r = n - 1) ELSE 0 END AS m2, avg(x) AS mean, max(x) - min(x) AS width FROM n_scored GROUP BY {by}, n),
n_fixed AS (SELECT *, m1 / sqrt(norm) + {polynomial(PV.LAST_WEIGHT, u)} AS f1,
  CASE WHEN n > 5 THEN m2 / sqrt(norm) + {polynomial(PV.NEXT_WEIGHT, u)} ELSE 0 END AS f2 FROM n_norm),
n_phi AS (SELECT *, (norm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * f1 * f1 - 2 * f2 * f2) AS phi FROM n_fixed),
n_stat AS (SELECT {keys}, o.n, CASE WHEN any_value(width) >= 1e-19 THEN least(1, pow(sum(x * CASE WHEN o.n = 3 THEN (r - 2) * sqrt(0.5)
  WHEN r IN (1, o.n) THEN sign(m) * f1 WHEN o.n > 5 AND r IN (2, o.n - 1) THEN sign(m) * f2
  ELSE m / sqrt(CASE WHEN o.n > 3 THEN phi END) END), 2) / sum((x - mean) * (x - mean))) END AS w
  FROM n_scored o JOIN n_phi USING ({by}) GROUP BY ALL),
n_z AS (SELECT *, CASE WHEN w IS NULL OR w >= 1 OR n = 3 OR (n <= 11 AND ln(1 - w) >= {gamma}) THEN NULL
  WHEN n <= 11 THEN {small} ELSE {large} END AS z FROM n_stat),
n_p AS (SELECT {by}, w, CASE WHEN w IS NULL THEN NULL WHEN n = 3 THEN greatest(0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))))
  WHEN w >= 1 THEN 1 WHEN z IS NULL THEN 1e-99 ELSE {normal_upper("z")} END AS p FROM n_z),
n_sizes AS (SELECT {by}, count({x}) AS n FROM {source} GROUP BY {by}),
normality AS (SELECT {by}, n, w, p FROM n_sizes LEFT JOIN n_p USING ({by}))"""


TESTS = DELTA.replace("WITH runs", "WITH RECURSIVE runs").rstrip() + ",\n" + ",\n".join(
    [t_test("delta_long", "metric", "delta_pct"), signed_rank("delta_long", "metric", "delta_pct"), shapiro("delta_long", "metric", "delta_pct")]
) + """,
centre AS (SELECT metric, count(*) AS n, quantile_cont(delta_pct, 0.5) AS median, avg(delta_pct) AS mean, stddev_samp(delta_pct) AS sd
  FROM delta_long GROUP BY metric),
side_by_side AS (SELECT c.*, s.p AS shapiro_p, r.p AS wilcox_p, t.p AS ttest_p FROM centre c LEFT JOIN normality s USING (metric)
  LEFT JOIN rank_tests r USING (metric) LEFT JOIN t_tests t USING (metric)),
chosen AS (SELECT *, CASE WHEN shapiro_p < 0.05 THEN 'Wilcoxon' WHEN shapiro_p >= 0.05 THEN 't-test' END AS test_used,
  CASE WHEN shapiro_p < 0.05 THEN wilcox_p WHEN shapiro_p >= 0.05 THEN ttest_p END AS p_value FROM side_by_side),
tests AS (SELECT *, p_value < 0.05 AS significant, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**'
  WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS significance_label FROM chosen)
"""
