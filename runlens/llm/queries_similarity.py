"""Query of the n-gram Jaccard join, with its SQL twin."""

from __future__ import annotations

from . import ngram_jaccard
from .common import table
from .registry import query

SIZE = 4
SHARE = (85, 100)

OP3_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, w[i + 1 : i + {SIZE}] AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - {SIZE} + 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE {SHARE[1]} * common >= {SHARE[0]} * (na.n + nb.n - common)
), ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.other) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query("op3_ngram_jaccard", OP3_SQL)
def op3(spark, sf_dir):
    """The component of every document."""
    return ngram_jaccard.link_components(table(spark, sf_dir, "documents"), size=SIZE, share=SHARE)
