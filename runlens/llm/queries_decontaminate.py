"""Query of benchmark decontamination, with its SQL twin."""

from __future__ import annotations

from . import decontaminate as d
from .common import table
from .registry import query

# RE2 has no $1 and names control characters by their code


def _extracted(text: str, names: str, name: str, number: str, unit: str, measured: str, token: str) -> str:
    plain = rf"regexp_replace(regexp_replace(coalesce({text}, ''), '[\x01-\x03]', ' ', 'g'), '\x04', chr(5), 'g')"
    named = f"regexp_replace({plain}, '{names}', {name}, 'g')"
    counted = f"regexp_replace({named}, '{d.NUMBERS}', {number}, 'g')"
    return f"regexp_extract_all(lower(regexp_replace({counted}, '{unit}', {measured}, 'g')), '{token}', 1)"


def _tokens(text: str) -> str:
    unit = rf"\x02 ?(?:{d.UNIT_WORDS})($|[^\p{{L}}\p{{N}}])"
    return _extracted(text, d.NAMES, r"'\1' || chr(1)", "chr(2)", unit, r"chr(2) || chr(3) || '\1'", d.TOKEN)


def _valued(text: str) -> str:
    unit = rf"(\x02[^\x04]*\x04) ?(?:{d.UNIT_WORDS})($|[^\p{{L}}\p{{N}}])"
    name, number = r"'\1' || chr(1) || '\2' || chr(4)", r"chr(2) || '\0' || chr(4)"
    return _extracted(text, d.VALUED_NAMES, name, number, unit, r"'\1' || chr(3) || '\2'", d.VALUED_TOKEN)


#: A window without a word counts with its values.
_WINDOW = """CASE WHEN len(list_filter(tokens[pos + 1 : pos + width], lambda t: t NOT IN (chr(1), chr(2), chr(3)))) = 0
            THEN vals[pos + 1 : pos + width] ELSE tokens[pos + 1 : pos + width] END"""


def _slots(source: str, keys: str) -> str:
    return f"""
  SELECT {keys}, pos, vals[pos + 1][2 : len(vals[pos + 1]) - 1] AS value
  FROM (SELECT {keys}, vals, unnest(list_filter(range(len(tokens)), lambda i: tokens[i + 1] IN (chr(1), chr(2)))) AS pos
        FROM {source}) AS s"""


OP10_SQL = rf"""
WITH forms AS (
  SELECT item_id, 0 AS form, coalesce(text, '') AS text FROM benchmark
  UNION ALL SELECT item_id, 1, '{d.INSIDE}' || coalesce(text, '') FROM benchmark
), read_items AS (SELECT item_id, form, {_tokens('text')} AS tokens, {_valued('text')} AS vals FROM forms
), items AS (  -- the second form only where it differs
  SELECT item_id, min(form) AS form, tokens, arg_min(vals, form) AS vals FROM read_items WHERE len(tokens) > 0 GROUP BY item_id, tokens
), texts AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents
), docs AS (SELECT doc_id, md5(text) AS key, {_tokens('text')} AS tokens, {_valued('text')} AS vals FROM texts
), item_places AS (
  SELECT *, least(len(tokens), {d.WINDOW}) AS width, unnest(range(len(tokens) - least(len(tokens), {d.WINDOW}) + 1)) AS pos FROM items
), iw AS (SELECT item_id, form, width, pos, {_WINDOW} AS w FROM item_places
), widths AS (SELECT DISTINCT width FROM iw
), doc_places AS (
  SELECT doc_id, key, width, tokens, vals, unnest(range(greatest(0, len(tokens) - width + 1))) AS pos FROM docs, widths
), dw AS (SELECT doc_id, key, width, pos, {_WINDOW} AS w FROM doc_places
), hits AS (
  SELECT DISTINCT doc_id, key, item_id, form, width, dw.pos - iw.pos AS shift, iw.pos AS place FROM dw JOIN iw USING (width, w)
), islands AS (
  SELECT *, place - row_number() OVER (PARTITION BY doc_id, key, item_id, form, shift ORDER BY place) AS island FROM hits
), runs AS (
  SELECT doc_id, key, item_id, form, width, shift, min(place) AS low, max(place) AS high FROM islands 
  GROUP BY doc_id, key, item_id, form, width, shift, island
), sizes AS (SELECT item_id, form, count(*) AS item_windows FROM iw GROUP BY ALL
), enough AS (
  SELECT doc_id, key, item_id, form, shift, any_value(item_windows) AS item_windows, sum(high - low + 1) AS n_windows
  FROM runs JOIN sizes USING (item_id, form) GROUP BY doc_id, key, item_id, form, shift
  HAVING max(high - low + 1) >= least({d.MATCHED}, any_value(item_windows))
), item_slots AS ({_slots('items', 'item_id, form')}
), doc_slots AS ({_slots('docs', 'doc_id, key')}
), inside AS (
  SELECT DISTINCT e.doc_id, e.key, e.item_id, e.form, e.shift, i.pos, i.value AS item_value
  FROM enough e JOIN runs r USING (doc_id, key, item_id, form, shift)
  JOIN item_slots i ON i.item_id = e.item_id AND i.form = e.form AND i.pos >= r.low AND i.pos < r.high + r.width
), pairs AS (
  SELECT i.doc_id, i.key, i.item_id, i.form, i.shift, i.item_value, count(*) AS n, min(s.value) AS least, max(s.value) AS most
  FROM inside i JOIN doc_slots s ON s.doc_id = i.doc_id AND s.key = i.key AND s.pos = i.pos + i.shift GROUP BY ALL
), checked AS (
  SELECT doc_id, key, item_id, form, shift, sum(n) AS n_slots,
         sum(CASE WHEN least <> item_value THEN n ELSE 0 END) AS n_changed, bool_or(least <> most) AS mixed
  FROM pairs GROUP BY doc_id, key, item_id, form, shift
), held AS (
  SELECT doc_id, item_id, form, sum(n_windows) AS n_windows, any_value(item_windows) AS item_windows,
         coalesce(sum(n_slots), 0) AS n_slots, coalesce(sum(n_changed), 0) AS n_changed
  FROM enough LEFT JOIN checked USING (doc_id, key, item_id, form, shift)
  WHERE NOT coalesce(mixed, false) GROUP BY doc_id, item_id, form
)
SELECT doc_id, item_id, CAST(n_windows AS BIGINT) AS n_windows, item_windows,
       CAST(n_slots AS BIGINT) AS n_slots, CAST(n_changed AS BIGINT) AS n_changed
FROM held QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY form) = 1
"""


@query("op10_decontaminate", OP10_SQL)
def op10(spark, sf_dir):
    """The benchmark items that documents hold."""
    return d.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
