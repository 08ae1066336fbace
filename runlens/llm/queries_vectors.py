"""Queries over the embeddings."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_bounds, topk_search, vector_codes
from .common import table
from .registry import query

# SQL states the definitions directly: all distances in every round, all products of every query.
_FINE = "len(embedding) {} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def _lloyd_sql() -> str:
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE {_FINE.format("= 64")}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40)"""
    ]
    for i in range(6):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS m FROM (
  SELECT r, k, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i}) GROUP BY r)"""
        )
        if i < 5:
            steps.append(
                f"""s{i} AS MATERIALIZED (SELECT k, p, sum(e) AS s, count(*) AS n FROM (
  SELECT a{i}.m.k AS k, unnest(v.x) AS e, unnest(range(1, 65)) AS p FROM v JOIN a{i} USING (r)) GROUP BY k, p),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN (
  SELECT k, list(CAST(floor_div AS BIGINT) ORDER BY p) AS x FROM (SELECT k, p, (s - ((s % n) + n) % n) / n AS floor_div FROM s{i}) GROUP BY k) n ON c{i}.k = n.k)"""
            )
    return ",\n".join(steps) + """,
e AS (SELECT vec_id, a5.m.k AS k, CAST(a5.m.d AS BIGINT) AS d FROM v JOIN a5 USING (r))
SELECT vec_id, CAST(e.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY e.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM e JOIN c5 ON e.k = c5.k"""


@query("op11_centroid_clusters", _lloyd_sql())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _ = centroid_bounds.cluster(table(spark, sf_dir, "embeddings"))
    # one row for each cluster
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, s, sum(own.values()), centroid_bounds.centroid_digest(centroids[c])) for c, s in own.items()]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.withColumnRenamed("id", "vec_id").join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _codes_sql() -> str:
    steps = [
        f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE {_FINE.format("> 0")}),
w AS MATERIALIZED (SELECT r, p, x[p * 16 + 1 : p * 16 + 16] AS x FROM v, (SELECT unnest(range(4)) AS p)),
b AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 256),
c0 AS MATERIALIZED (SELECT p, e, x FROM w JOIN b USING (r))"""
    ]
    for i in range(5):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS m FROM (
  SELECT w.r, w.p, c.e, list_sum(list_transform(list_zip(w.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM w JOIN c{i} c ON w.p = c.p) GROUP BY r, p)"""
        )
        if i < 4:
            steps.append(
                f"""s{i} AS MATERIALIZED (SELECT p, e, q, sum(z) AS s, count(*) AS n FROM (
  SELECT w.p, a{i}.m.e AS e, unnest(w.x) AS z, unnest(range(1, 17)) AS q FROM w JOIN a{i} ON w.r = a{i}.r AND w.p = a{i}.p) GROUP BY p, e, q),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY q) AS x FROM s{i} GROUP BY p, e) n ON c.p = n.p AND c.e = n.e)"""
            )
    return ",\n".join(steps) + """,
f AS (SELECT r, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c4) AS codebooks_sha256
FROM v JOIN f USING (r)"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.reshape(-1).tolist()).encode()).hexdigest()
    byte = lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"),
        F.concat_ws("", F.transform("codes", byte)).alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


@query("op13_topk_products", f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS y
  FROM embeddings WHERE {_FINE.format("> 0")}),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.y, c.y), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""")
def op13_topk_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
