"""Queries of exact duplicates and URL filters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, url_filter
from .common import table
from .registry import query

#: The rules of the URL query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""

OP4_SQL = rf"""
WITH RECURSIVE u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), s AS (
  SELECT *, regexp_replace(replace(replace(replace(path, '*', '%2A'), '{{', '%7B'), '}}', '%7D'), '[0-9]+', '{{n}}', 'g') AS shape,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
), l AS (SELECT doc_id, max(toxic) AS bad FROM labels GROUP BY doc_id
), shapes AS (
  SELECT host, shape, count(*) AS n, count(bad) AS labels, coalesce(sum(bad), 0) AS bads
  FROM s LEFT JOIN l ON l.doc_id = s.page_id GROUP BY host, shape
), walk AS (  -- one level a turn, from the root; the children of a node are those of its template
  SELECT host, shape, n, string_split(shape, '/') AS rest, '' AS template, 0 AS depth FROM shapes
  UNION ALL
  SELECT host, shape, n, rest[2:], CASE WHEN depth = 0 THEN general ELSE template || '/' || general END, depth + 1
  FROM (
    SELECT *, CASE WHEN kinds > {url_filter.MAX_CHILDREN} AND child_n < {url_filter.MIN_SHARE} * total
                   THEN '*' ELSE rest[1] END AS general
    FROM (
      SELECT *, sum(n) OVER (PARTITION BY host, template) AS total,
             sum(n) OVER (PARTITION BY host, template, rest[1]) AS child_n,
             count(DISTINCT rest[1]) OVER (PARTITION BY host, template) AS kinds
      FROM walk WHERE len(rest) > 0
    )
  )
), templates AS (SELECT host, shape, template FROM walk WHERE len(rest) = 0
), leaves AS (
  SELECT host, template, sum(labels) AS labels, sum(bads) AS bads,
         regexp_replace(template, '[^/{{}}*]+((?:/[^/]*[{{}}*][^/]*)*/?)$', '*\1') AS kind
  FROM templates JOIN shapes USING (host, shape) GROUP BY host, template
), pooled AS (
  SELECT *, sum(labels) OVER k AS all_labels, sum(bads) OVER k AS all_bads
  FROM leaves WINDOW k AS (PARTITION BY host, kind)
), tested AS (
  SELECT *, all_labels - labels AS other, all_bads - bads AS other_bads,
         (all_bads + {url_filter.WEIGHT * url_filter.PRIOR}) / (all_labels + {url_filter.WEIGHT}) AS rate
  FROM pooled
), branches AS (
  SELECT host, template, labels, bads,
         coalesce(labels > 0 AND other > 0 AND abs(bads / labels - other_bads / other)
                  <= {url_filter.Z} * sqrt(rate * (1 - rate) * (1.0 / labels + 1.0 / other)), false) AS merged, kind
  FROM tested
), grouped AS (
  SELECT *, CASE WHEN merged THEN kind ELSE template END AS grp FROM branches
), bad AS (
  SELECT host, grp, merged FROM grouped GROUP BY ALL
  HAVING (sum(bads) + {url_filter.WEIGHT * url_filter.PRIOR}) / (sum(labels) + {url_filter.WEIGHT}) >= {url_filter.REJECT}
), with_kind AS (  -- branches without labels that go with the merged ones of their kind
  SELECT DISTINCT b.host, b.template, b.kind FROM grouped b JOIN grouped m ON m.host = b.host AND m.kind = b.kind AND m.merged
  WHERE b.labels = 0
), above AS (
  SELECT host, template, labels, bads, string_split(template, '/') AS seg, unnest(range(1, len(string_split(template, '/')) + 1)) AS d
  FROM leaves
), ancestors AS (
  SELECT host, d, array_to_string(seg[1:d], '/') AS node, sum(labels) AS labels, sum(bads) AS bads
  FROM above GROUP BY ALL HAVING sum(labels) > 0
), nearest AS (
  SELECT a.host, a.template, arg_max(n.node, n.d) AS node, arg_max(n.labels, n.d) AS labels, arg_max(n.bads, n.d) AS bads
  FROM above a JOIN ancestors n ON n.host = a.host AND n.d = a.d AND n.node = array_to_string(a.seg[1:a.d], '/')
  WHERE a.labels = 0 AND NOT EXISTS (SELECT 1 FROM with_kind w WHERE w.host = a.host AND w.template = a.template)
  GROUP BY a.host, a.template
), bad_templates AS (
  SELECT host, template, grp FROM grouped JOIN bad USING (host, grp, merged)
  UNION ALL
  SELECT w.host, w.template, w.kind FROM with_kind w JOIN bad b ON b.host = w.host AND b.grp = w.kind AND b.merged
  UNION ALL
  SELECT host, template, node || '/**' FROM nearest
  WHERE (bads + {url_filter.WEIGHT * url_filter.PRIOR}) / (labels + {url_filter.WEIGHT}) >= {url_filter.REJECT}
), rejected AS (SELECT t.host, t.shape, b.grp AS template FROM templates t JOIN bad_templates b USING (host, template)
)
SELECT page_id, s.host, s.path, s.rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN r.template IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, r.template
FROM s LEFT JOIN rejected r ON r.host = s.host AND r.shape = s.shape
"""


@query("op4_url_filter", OP4_SQL)
def op4(spark, sf_dir):
    """The verdict on every page's URL; toxic labels of the same id teach the templates."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), labels, RULES)


@query("op5_exact_dedup", OP5_SQL)
def op5(spark, sf_dir):
    """The group of equal texts of every document."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
