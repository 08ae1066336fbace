"""Queries of line deduplication and licence scans, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import license_scan as ls
from . import line_dedup
from .common import table
from .registry import query

OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (SELECT doc_id, source, unnest(range(len(parts))) AS pos, trim(unnest(parts)) AS line FROM d
), common AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}
), flagged AS (
  SELECT doc_id, list(pos) AS places FROM l SEMI JOIN common USING (line) GROUP BY doc_id
), other AS (SELECT DISTINCT doc_id, true AS own FROM l ANTI JOIN common USING (line) WHERE line <> ''
), j AS (
  SELECT d.doc_id, body, parts, places, places IS NOT NULL AND coalesce(own, false) AS clean
  FROM d LEFT JOIN flagged USING (doc_id) LEFT JOIN other USING (doc_id)
)
SELECT doc_id, len(parts) AS n_lines, coalesce(len(places), 0) AS boilerplate_lines,
       CASE WHEN clean THEN len(places) ELSE 0 END AS removed_lines,
       sha256(CASE WHEN clean THEN array_to_string(
         list_transform(list_filter(range(len(parts)), lambda i: NOT list_contains(places, i)), lambda i: parts[i + 1]), chr(10))
         ELSE body END) AS text_sha256
FROM j
"""


@query("op7_line_dedup", OP7_SQL)
def op7(spark, sf_dir):
    """Boilerplate lines of every document, and its text without them."""
    docs = table(spark, sf_dir, "documents")
    before = docs.withColumn("n_lines", F.size(line_dedup.lines(F.col("text"))).cast("long"))
    return line_dedup.remove_boilerplate(before).select(
        "doc_id",
        "n_lines",
        "boilerplate_lines",
        "removed_lines",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


_TEMPLATES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(ls.NOTICES.items()))
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '([\p{{L}}\p{{N}}]+)', 1)"
OP8_SQL = f"""
WITH t AS (SELECT name AS template, {_WORDS.format('text')} AS w FROM (VALUES {_TEMPLATES}) AS v(name, text)
), tk AS (SELECT template, w, len(w) AS length, least({ls.SHINGLE}, len(w)) AS size, greatest(1, len(w) // 4) AS step FROM t
), ts AS (
  SELECT DISTINCT template, length, size, step, w[i + 1 : i + size] AS s
  FROM (SELECT *, unnest(range(length - size + 1)) AS i FROM tk)
), tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template
), d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents
), sizes AS (SELECT DISTINCT size FROM tk
), ds AS (
  SELECT doc_id, size, i, w[i + 1 : i + size] AS s
  FROM (SELECT doc_id, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS i FROM d, sizes)
), hits AS (SELECT doc_id, template, length, step, size, i, s FROM ds JOIN ts USING (size, s)
), placed AS (
  SELECT *, unnest(range(greatest(0, (i - (length + step - 1 - size) + step - 1) // step), i // step + 1)) * step AS place FROM hits
), windows AS (
  SELECT doc_id, template, place, count(DISTINCT s) / any_value(n) AS containment
  FROM placed JOIN tn USING (template) GROUP BY doc_id, template, place
)
SELECT doc_id, template, max(containment) AS containment,
       CAST(arg_max(-place, {{'c': containment, 'p': -place}}) * -1 AS INTEGER) AS place
FROM windows WHERE containment >= {ls.CONTAINED} GROUP BY doc_id, template
"""


@query("op8_license_scan", OP8_SQL)
def op8(spark, sf_dir):
    """The licence notices that documents hold."""
    return ls.scan(table(spark, sf_dir, "documents"))
