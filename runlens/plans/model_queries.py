"""Queries of the vector, pairwise, sequence, grid and text operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import clustering as KM
from runlens.operators import grid as G
from runlens.operators import learning as ML
from runlens.operators import neural as NN
from runlens.operators import pairs as PR
from runlens.operators import sequences as SQ
from runlens.operators import text as TX
from runlens.operators.order_stats import bucket_of
from runlens.operators.sizing import attach_row
from runlens.plans import sql_text as Q
from runlens.plans.driver_tables import table
from runlens.plans.registry import query


# -- vectors ----------------------------------------------------------------
def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def _label_means(points: DataFrame) -> DataFrame:
    """One centroid per label, numbered by the label."""
    means = KM.kmeans_update(points.select(F.col("label").alias("cluster"), "vec"))
    return means.orderBy("cluster")


_POINTS_SQL = """WITH cells AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
centres AS (SELECT label AS cluster, pos, avg(v) AS m FROM cells GROUP BY label, pos),
gaps AS (SELECT vec_id, cluster, sum((v - m) * (v - m)) AS d2, sum(v * m) AS xy
  FROM cells JOIN centres USING (pos) GROUP BY vec_id, cluster),
assigned AS (SELECT vec_id, arg_min(cluster, (d2, cluster)) AS cluster, min(d2) AS d2 FROM gaps GROUP BY vec_id),
updated AS (SELECT a.cluster, pos, avg(v) AS m FROM cells JOIN assigned a USING (vec_id) GROUP BY a.cluster, pos)
"""


@query("kmeans_assign", "vec_id:i cluster:i d2", _POINTS_SQL + "SELECT * FROM assigned")
def kmeans_assign(spark, sf_dir):
    points = _points(spark, sf_dir)
    return KM.kmeans_assign(points, _label_means(points))


@query("kmeans_update", "cluster:i pos:i m:6", _POINTS_SQL + "SELECT cluster, pos - 1 AS pos, m FROM updated")
def kmeans_update(spark, sf_dir):
    points = _points(spark, sf_dir)
    start = _label_means(points)
    updated = KM.kmeans_update(KM.kmeans_assign(points, start), start)
    # clusters without members keep their start and are left out here
    return updated.filter("n > 0").select("cluster", F.posexplode("centroid").alias("pos", "m"))


@query("kmeans_inertia", "inertia", _POINTS_SQL + """SELECT sum((v - m) * (v - m)) AS inertia
FROM cells JOIN assigned a USING (vec_id) JOIN updated u ON u.cluster = a.cluster AND u.pos = cells.pos""")
def kmeans_inertia(spark, sf_dir):
    points = _points(spark, sf_dir)
    start = _label_means(points)
    assigned = KM.kmeans_assign(points, start)
    return KM.kmeans_inertia(assigned, KM.kmeans_update(assigned, start))


@query("kmeans_fit", "step:i inertia converged:s")
def kmeans_fit(spark, sf_dir):
    """Until no vector changes its cluster."""
    _, history = KM.kmeans_fit(_points(spark, sf_dir), k=10, key="vec_id", seed=7)
    return history


def _vector_rows(spark, sf_dir):
    points = _points(spark, sf_dir)
    rows = points.select(F.col("vec_id").alias("i"), "vec")
    return rows, _label_means(points).select(F.col("cluster").alias("j"), F.col("centroid").alias("vec"))


@query("vector_distance", "i:i j:i d", _POINTS_SQL + "SELECT vec_id AS i, cluster AS j, sqrt(d2) AS d FROM gaps")
def vector_distance(spark, sf_dir):
    return PR.vector_distance(*_vector_rows(spark, sf_dir))


def _kernel_query(name: str, sql: str, **arguments: float) -> None:
    @query(f"kernel_matrix_{name}", "i:i j:i k", _POINTS_SQL + f"SELECT vec_id AS i, cluster AS j, {sql} AS k FROM gaps")
    def kernel_matrix(spark, sf_dir):
        return PR.kernel_matrix(*_vector_rows(spark, sf_dir), name, **arguments)


_kernel_query("linear", "xy + 1", coef0=1.0)
_kernel_query("poly", "pow(0.5 * xy + 1, 3)", degree=3.0, coef0=1.0, gamma=0.5)
_kernel_query("rbf", "exp(-0.5 * d2)", gamma=0.5)


@query("kernel_svm_score", "i:i score predicted:i", _POINTS_SQL + """SELECT vec_id AS i,
  sum(0.1 * (cluster + 1) * CASE WHEN cluster < 5 THEN 1 ELSE -1 END * exp(-0.5 * d2)) + 0.05 AS score,
  CASE WHEN sum(0.1 * (cluster + 1) * CASE WHEN cluster < 5 THEN 1 ELSE -1 END * exp(-0.5 * d2)) + 0.05 > 0
    THEN 1 ELSE -1 END AS predicted FROM gaps GROUP BY vec_id""")
def kernel_svm_score(spark, sf_dir):
    rows, centres = _vector_rows(spark, sf_dir)
    support = centres.select(
        "vec",
        ((F.col("j") + 1) * 0.1).alias("alpha"),
        F.when(F.col("j") < 5, 1).otherwise(-1).alias("y"),
    )
    return PR.kernel_svm_score(rows, support, 0.05, "rbf", gamma=0.5)


# -- networks ---------------------------------------------------------------
def _rule_weights(sizes: list[int]) -> list[np.ndarray]:
    """Weights by a rule, so that the SQL twin can state them."""
    return [
        np.array([[((3 * r + 2 * c) % 7 - 3) / 10 for c in range(1, b + 1)] for r in range(1, a + 1)])
        for a, b in zip(sizes, sizes[1:])
    ]


_LAYER = "1 / (1 + exp(-sum(v * ((3 * pos + 2 * n) % 7 - 3) / 10))) AS v"


@query("mlp_score", "vec_id:i score:6 predicted:i", f"""WITH x AS (
  SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
h1 AS (SELECT vec_id, n AS pos, {_LAYER} FROM x, range(1, 5) AS t(n) GROUP BY vec_id, n),
h2 AS (SELECT vec_id, n AS pos, {_LAYER} FROM h1, range(1, 4) AS t(n) GROUP BY vec_id, n),
o AS (SELECT vec_id, n AS pos, {_LAYER} FROM h2, range(1, 2) AS t(n) GROUP BY vec_id, n)
SELECT vec_id, v AS score, CASE WHEN v > 0.5 THEN 1 ELSE 0 END AS predicted FROM o""")
def mlp_score(spark, sf_dir):
    return NN.mlp_score(_points(spark, sf_dir), _rule_weights([64, 4, 3, 1]), cut=0.5)


@query("mlp_fit", "epoch:i mse:6 slope converged:s")
def mlp_fit(spark, sf_dir):
    """To the bound on the slopes."""
    rows = _points(spark, sf_dir).withColumn("label", (F.col("label") >= 5).cast("int"))
    _, history = NN.mlp_fit(rows, [4, 3], decay=1e-4, seed=3)
    return history


# -- discriminant, scaling, accuracy ----------------------------------------
_LDA_SQL = """WITH c AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS mean, var_samp(l_extendedprice) AS v
  FROM lineitem GROUP BY l_returnflag),
model AS (SELECT l_returnflag, n, mean, n / (SELECT sum(n) FROM c) AS prior,
  (SELECT sum(v * (n - 1)) / (sum(n) - count(*)) FROM c) AS variance FROM c)
"""


def _lda(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice"
    )
    return rows, ML.lda_fit(rows, "l_returnflag", "l_extendedprice")


@query("lda_fit", "l_returnflag:s n:i mean prior variance:0", _LDA_SQL + "SELECT * FROM model")
def lda_fit(spark, sf_dir):
    return _lda(spark, sf_dir)[1]


@query("lda_predict", "actual:s predicted:s n:i", """WITH runs AS (SELECT l_returnflag AS actual, l_extendedprice AS x, count(*) AS n
  FROM lineitem GROUP BY 1, 2),
c AS (SELECT actual AS class, sum(n) AS n, sum(n * x) / sum(n) AS mean FROM runs GROUP BY 1),
pooled AS (SELECT sum(r.n * (x - mean) * (x - mean)) / (sum(r.n) - count(DISTINCT class)) AS variance, sum(r.n) AS total
  FROM runs r JOIN c ON r.actual = c.class),
best AS (SELECT r.actual, r.x, any_value(r.n) AS n,
  arg_max(class, x * mean / variance - mean * mean / (2 * variance) + ln(c.n / total)) AS predicted
  FROM runs r, c, pooled GROUP BY r.actual, r.x)
SELECT actual, predicted, sum(n) AS n FROM best GROUP BY 1, 2""")
def lda_predict(spark, sf_dir):
    rows, model = _lda(spark, sf_dir)
    predicted = ML.lda_predict(rows, model, "l_returnflag", "l_extendedprice")
    return predicted.groupBy(F.col("l_returnflag").alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("accuracy", "n:i correct:i incorrect:i pct", """SELECT count(*) AS n,
  count(*) FILTER (WHERE quality = toxic) AS correct, count(*) FILTER (WHERE quality <> toxic) AS incorrect,
  avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) * 100 AS pct FROM labels""")
def accuracy(spark, sf_dir):
    return ML.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("minmax_scale", "c_custkey:i c_acctbal c_nationkey", """WITH t AS (SELECT min(c_acctbal) AS a0, max(c_acctbal) AS a1,
  min(c_nationkey) AS n0, max(c_nationkey) AS n1 FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT c_custkey, (c_acctbal - a0) / (a1 - a0) AS c_acctbal, (c_nationkey - n0) / (n1 - n0) AS c_nationkey FROM customer, t""")
def minmax_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return ML.minmax_scale(rows.filter(F.col("c_mktsegment") != "BUILDING"), rows, ["c_acctbal", "c_nationkey"])


@query("linear_svm_fit", "term:s weight:2 objective:0 gap:0 steps:i converged:s")
def linear_svm_fit(spark, sf_dir):
    """All components of the vectors, until the duality gap is a thousandth of the objective."""
    points = _points(spark, sf_dir)
    width = points.agg(F.max(F.size("vec"))).first()[0]
    names = [f"x{i}" for i in range(width)]
    rows = points.select(F.when(F.col("label") < 5, 1).otherwise(-1).alias("label"), *[F.col("vec")[i].alias(n) for i, n in enumerate(names)])
    return ML.linear_svm_fit(rows, "label", names)


_NORMAL_SQL = f"sqrt(-2 * ln({Q.draw('(label + 1)', "'r'", 'c_custkey')})) * cos(2 * pi() * {Q.draw('(label + 1)', "'a'", 'c_custkey')})"


@query("normal_sample", "label:i key:i x", f"""SELECT label, c_custkey AS key, 5.0 * (label + 1) + {_NORMAL_SQL} AS x
FROM customer, range(3) AS t(label)""")
def normal_sample(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    classes = [ML.normal_sample(keys, "key", 5.0 * (c + 1), 1.0, c, seed=c + 1) for c in range(3)]
    return classes[0].unionByName(classes[1]).unionByName(classes[2])


# -- pairs ------------------------------------------------------------------
@query("pairs_within", "i:i j:i d", """SELECT c_custkey AS i, s_suppkey AS j,
  sqrt(pow(c_nationkey - s_nationkey, 2) + pow(c_acctbal / 100 - s_acctbal / 100, 2)) AS d FROM customer, supplier
WHERE pow(c_nationkey - s_nationkey, 2) + pow(c_acctbal / 100 - s_acctbal / 100, 2) <= 2.25""")
def pairs_within(spark, sf_dir):
    """Customers and suppliers with nearby nations and balances."""
    point = lambda name, key, prefix: table(spark, sf_dir, name).select(
        F.col(f"{prefix}_{key}").alias("i" if name == "customer" else "j"),
        F.col(f"{prefix}_nationkey").alias("x"),
        (F.col(f"{prefix}_acctbal") / 100).alias("y"),
    )
    return PR.pairs_within(point("customer", "custkey", "c"), point("supplier", "suppkey", "s"), 1.5)


def _nation_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("j"))
        .agg(F.avg("c_acctbal").alias("y"))
        .withColumn("x", F.col("j").cast("double"))
    )


_CENTRES_SQL = """WITH centres AS (SELECT c_nationkey AS j, CAST(c_nationkey AS DOUBLE) AS x, avg(c_acctbal) AS y
  FROM customer GROUP BY c_nationkey)
"""


@query("pairwise_distance", "i:i j:i d", _CENTRES_SQL + """SELECT s_suppkey AS i, j,
  sqrt(pow(x - s_nationkey, 2) + pow(y - s_acctbal, 2)) AS d FROM supplier, centres""")
def pairwise_distance(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("i"),
        F.col("s_nationkey").cast("double").alias("x"),
        F.col("s_acctbal").alias("y"),
    )
    return PR.pairwise_distance(suppliers, _nation_centres(spark, sf_dir))


@query("all_pairs", "c_custkey:i r_regionkey:i value", """SELECT c_custkey, r_regionkey, c_acctbal * (r_regionkey + 1) AS value
FROM customer, region""")
def all_pairs(spark, sf_dir):
    return PR.all_pairs(
        table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"),
        table(spark, sf_dir, "region").select("r_regionkey"),
        lambda r: F.col("c_acctbal") * (r["r_regionkey"] + 1),
        ["c_custkey"],
        "r_regionkey",
    )


@query("pairwise_interaction", "p_partkey:i fx fy", """WITH e AS (
  SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS y,
         p_retailprice AS mass FROM part),
p AS (SELECT x, y, sum(mass) AS mass FROM e GROUP BY x, y),
f AS (SELECT a.x, a.y,
    sum(b.mass * (b.x - a.x) / pow(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + 1, 1.5)) AS fx,
    sum(b.mass * (b.y - a.y) / pow(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + 1, 1.5)) AS fy
  FROM p a, p b GROUP BY a.x, a.y)
SELECT p_partkey, fx, fy FROM e JOIN f ON e.x = f.x AND e.y = f.y""")
def pairwise_interaction(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_size").cast("double").alias("x"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("double").alias("y"),
        F.col("p_retailprice").alias("mass"),
    )
    return PR.pairwise_interaction(entities, "p_partkey", softening=1.0)


# -- routes -----------------------------------------------------------------
def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in order of date: the priority is the place visited."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("route"),
        F.unix_date(F.col("o_orderdate").cast("date")).alias("day"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("node"),
        (F.col("o_totalprice") / 1000).alias("x"),
        F.month("o_orderdate").cast("double").alias("y"),
    )


def _legs(spark, sf_dir):
    # a customer with very many orders is cut by day and, within it, by order key
    stops = _stops(spark, sf_dir)
    ends = stops.agg(F.min("seq").cast("double").alias("__lo"), F.max("seq").cast("double").alias("__hi"))
    part = bucket_of(F.col("seq").cast("double"), F.col("__lo"), F.col("__hi"), 64)
    located = attach_row(stops, ends).withColumn("chunk", F.col("day") * 64 + part).drop("__lo", "__hi")
    return SQ.route_legs(located, "route", ["day", "seq"], F.col("chunk"))


_LEGS_SQL = """WITH stops AS (
  SELECT o_custkey AS route, CAST(o_orderdate AS DATE) AS day, o_orderkey AS seq, o_orderpriority AS node,
         o_totalprice / 1000 AS x, CAST(month(o_orderdate) AS DOUBLE) AS y FROM orders),
linked AS (
  SELECT *, lead(node) OVER w AS node1, lead(x) OVER w AS x1, lead(y) OVER w AS y1,
         first_value(node) OVER w AS node0, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0,
         count(*) OVER (PARTITION BY route) AS n
  FROM stops WINDOW w AS (PARTITION BY route ORDER BY day, seq)),
legs AS (
  SELECT route, node AS from_node, coalesce(node1, node0) AS to_node,
         sqrt(pow(coalesce(x1, x0) - x, 2) + pow(coalesce(y1, y0) - y, 2)) AS length
  FROM linked WHERE n > 1),
lengths AS (SELECT route, count(*) AS n_legs, sum(length) AS length FROM legs GROUP BY route)
"""


@query("route_length", "route:i n_legs:i length", _LEGS_SQL + "SELECT * FROM lengths")
def route_length(spark, sf_dir):
    return SQ.route_length(_legs(spark, sf_dir), "route")


@query("shortest_route", "route:i length", _LEGS_SQL + "SELECT route, length FROM lengths ORDER BY length, route LIMIT 1")
def shortest_route(spark, sf_dir):
    return SQ.shortest_route(SQ.route_length(_legs(spark, sf_dir), "route"), "route")


@query("edge_weights", "from_node:s to_node:s weight", _LEGS_SQL + """, edges AS (
  SELECT DISTINCT a.o_orderpriority AS from_node, b.o_orderpriority AS to_node
  FROM (SELECT DISTINCT o_orderpriority FROM orders) a, (SELECT DISTINCT o_orderpriority FROM orders) b),
added AS (SELECT least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, sum(10 / nullif(l.length, 0)) AS added
  FROM legs JOIN lengths l USING (route) GROUP BY 1, 2)
SELECT from_node, to_node, 0.7 + coalesce(added, 0) AS weight FROM edges
LEFT JOIN added ON a = least(from_node, to_node) AND b = greatest(from_node, to_node)""")
def edge_weights(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("from_node")).distinct()
    edges = PR.all_pairs(
        nodes, nodes.withColumnRenamed("from_node", "to_node"), lambda r: F.lit(1.0), ["from_node"], "to_node", "weight"
    )
    return SQ.edge_weights(edges, legs, SQ.route_length(legs, "route"), "route", decay=0.7, q=10.0)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates of their customer: priced weight, dated distance."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source"),
        F.col("o_orderkey").alias("target"),
        (F.col("o_totalprice") / 1000).alias("weight"),
        F.dayofmonth("o_orderdate").cast("double").alias("distance"),
    )


@query("transition_probability", "source:i target:i prob:8", """WITH s AS (SELECT o_custkey AS source, o_orderkey AS target,
  pow(o_totalprice / 1000, 1.0) * pow(1.0 / day(o_orderdate), 2.0) AS score FROM orders)
SELECT source, target, score / sum(score) OVER (PARTITION BY source) AS prob FROM s""")
def transition_probability(spark, sf_dir):
    return SQ.transition_probability(_candidates(spark, sf_dir), "source", "target", 1.0, 2.0)


@query("weighted_pick", "source:i target:i", f"""WITH s AS (SELECT o_custkey AS source, o_orderkey AS target,
  pow(o_totalprice / 1000, 1.0) * pow(1.0 / day(o_orderdate), 2.0) AS score FROM orders),
c AS (SELECT source, target, score / sum(score) OVER (PARTITION BY source) AS prob FROM s)
SELECT source, arg_max(target, ln({Q.draw("'11'", 'source', 'target')}) / prob) AS target FROM c GROUP BY source""")
def weighted_pick(spark, sf_dir):
    chances = SQ.transition_probability(_candidates(spark, sf_dir), "source", "target", 1.0, 2.0)
    return SQ.weighted_pick(chances, "source", "target", seed=11)


# -- numbers ----------------------------------------------------------------
def _prime_squares(spark, sf_dir):
    """Squares of the primes up to twice the root of the largest part key."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    top = keys.agg((F.sqrt(F.max("k").cast("double")) * 2 + 3).alias("top"))
    numbers = attach_row(keys, top).filter(F.col("k") <= F.col("top")).select("k")
    return SQ.primes_upto(numbers, "k").select((F.col("k") * F.col("k")).alias("square"))


_BOUNDS_SQL = """WITH top AS (SELECT sqrt(max(p_partkey)) * 2 + 3 AS top FROM part),
small AS (SELECT p_partkey AS k FROM part, top WHERE p_partkey BETWEEN 2 AND top),
primes AS (SELECT k FROM small s WHERE NOT EXISTS (SELECT 1 FROM small d WHERE d.k < s.k AND s.k % d.k = 0)),
bounds AS (SELECT p_partkey AS v, max(CASE WHEN k * k <= p_partkey THEN k END) AS lower,
  min(CASE WHEN k * k >= p_partkey THEN k END) AS upper FROM part, primes GROUP BY p_partkey)
"""


def _bounded(spark, sf_dir):
    """Part keys between the squares of primes."""
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"))
    return SQ.neighbour_bounds(values, "v", _prime_squares(spark, sf_dir), "square")


@query("neighbour_bounds", "v:i lower upper", _BOUNDS_SQL + "SELECT v, lower * lower AS lower, upper * upper AS upper FROM bounds")
def neighbour_bounds(spark, sf_dir):
    return _bounded(spark, sf_dir)


@query("divisible_by_one_bound", "n:i total:i", _BOUNDS_SQL + """SELECT count(*) AS n, sum(v) AS total FROM bounds
WHERE lower IS NOT NULL AND coalesce(v % nullif(lower, 0) = 0, false) <> coalesce(v % nullif(upper, 0) = 0, false)""")
def divisible_by_one_bound(spark, sf_dir):
    bounded = _bounded(spark, sf_dir).filter(F.col("lower").isNotNull())
    return SQ.divisible_by_one_bound(bounded, "v").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def _ratios(spark, sf_dir):
    return SQ.canonical_ratio_distinct(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity")


_RATIO_SQL = """WITH r AS (SELECT DISTINCT l_linenumber // gcd(l_linenumber, CAST(l_quantity AS BIGINT)) AS num,
  CAST(l_quantity AS BIGINT) // gcd(l_linenumber, CAST(l_quantity AS BIGINT)) AS den FROM lineitem)
"""


@query("canonical_ratio_distinct", "num:i den:i", _RATIO_SQL + "SELECT num, den FROM r")
def canonical_ratio_distinct(spark, sf_dir):
    return _ratios(spark, sf_dir)


@query("ratio_total", "n_ratios:i total", _RATIO_SQL + "SELECT count(*) AS n_ratios, sum(num / den) AS total FROM r")
def ratio_total(spark, sf_dir):
    return SQ.ratio_total(_ratios(spark, sf_dir))


# -- grids ------------------------------------------------------------------
def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and hour, one grid per event type and month."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyy-MM")).alias("id"),
            (F.dayofmonth("ts") - 1).alias("r"),
            F.hour("ts").alias("c"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


_GRID_SQL = """WITH grid AS (SELECT event_type || '-' || strftime(ts, '%Y-%m') AS id, day(ts) - 1 AS r, hour(ts) AS c,
  CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3)
"""
_KERNEL = [[0.1, 0.0, -0.1], [0.2, 0.0, -0.2], [0.1, 0.0, -0.1]]
_TAPS = ", ".join(f"({i}, {j}, {w})" for i, line in enumerate(_KERNEL) for j, w in enumerate(line))


@query("conv2d_grid", "id:s out_r:i out_c:i value:6", _GRID_SQL + f""", taps AS (SELECT * FROM (VALUES {_TAPS}) AS t(dr, dc, w)),
dense AS (SELECT i.id, y.r, x.c, coalesce(g.value, 0) AS value FROM (SELECT DISTINCT id FROM grid) AS i
  CROSS JOIN range(31) AS y(r) CROSS JOIN range(24) AS x(c) LEFT JOIN grid g ON g.id = i.id AND g.r = y.r AND g.c = x.c),
net AS (SELECT id, (r - dr) // 2 AS out_r, (c - dc) // 2 AS out_c, sum(value * w) AS net FROM dense, taps
  WHERE r >= dr AND c >= dc AND r - dr <= 28 AND c - dc <= 21 AND (r - dr) % 2 = 0 AND (c - dc) % 2 = 0 GROUP BY 1, 2, 3)
SELECT id, out_r, out_c, 1 / (1 + exp(-(net - 0.25))) AS value FROM net""")
def conv2d_grid(spark, sf_dir):
    return G.conv2d_grid(_grid(spark, sf_dir), _KERNEL, rows=31, cols=24, stride=2, bias=0.25)


def _pool_query(how: str, agg: str) -> None:
    @query(f"pool_grid_{how}", "id:s out_r:i out_c:i value", _GRID_SQL + f""", dense AS (
  SELECT i.id, y.r, x.c, coalesce(g.value, 0) AS value FROM (SELECT DISTINCT id FROM grid) AS i
  CROSS JOIN range(31) AS y(r) CROSS JOIN range(24) AS x(c) LEFT JOIN grid g ON g.id = i.id AND g.r = y.r AND g.c = x.c)
SELECT id, r // 4 AS out_r, c // 4 AS out_c, {agg}(value) AS value FROM dense GROUP BY 1, 2, 3""")
    def pool_grid(spark, sf_dir):
        return G.pool_grid(_grid(spark, sf_dir), 4, rows=31, cols=24, how=how)


_pool_query("average", "avg")
_pool_query("max", "max")


# -- text -------------------------------------------------------------------
_TARGET = "small widget of the year"
_ALPHABET = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,"


def _score_sql(text: str) -> str:
    return " + ".join(
        f"CASE WHEN substr({text}, {i}, 1) = '{ch}' THEN 1 ELSE 0 END" for i, ch in enumerate(_TARGET, 1)
    )


@query("positional_match", "doc_id:i score:i", f"SELECT doc_id, {_score_sql('text')} AS score FROM documents")
def positional_match(spark, sf_dir):
    return TX.positional_match(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _TARGET)


@query("positional_match_best", "p_name:s score:i", f"""SELECT p_name, {_score_sql('p_name')} AS score FROM part
ORDER BY score DESC, p_name LIMIT 25""")
def positional_match_best(spark, sf_dir):
    return TX.positional_match(table(spark, sf_dir, "part").select("p_name"), "p_name", _TARGET, n=25)


@query("alphabet_violations", "doc_id:i violations:s", f"""WITH ch AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^{_ALPHABET}]')) AS ch FROM documents)
SELECT d.doc_id, coalesce(string_agg(hex(ch), ' ' ORDER BY hex(ch)), '') AS violations
FROM documents d LEFT JOIN ch ON d.doc_id = ch.doc_id GROUP BY d.doc_id""")
def alphabet_violations(spark, sf_dir):
    found = TX.alphabet_violations(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _ALPHABET)
    codes = F.transform("violations", lambda ch: F.hex(ch))
    return found.select("doc_id", F.array_join(F.array_sort(codes), " ").alias("violations"))
