"""Query op8: line-first quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import table
from tidecast.llm.quality import BOILERPLATE, NAVIGATION, quality

NAME = "op8_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), cleaned=False)


_SP = r"[\x20\x09-\x0D]"
_NAV = ", ".join(f"'{x}'" for x in NAVIGATION)
_BOIL = " OR ".join(f"contains(key, '{x}')" for x in BOILERPLATE)

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         length(regexp_replace(t, '{_SP}', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM p),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM h, range(0, 5) AS x(j) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (
  SELECT r, line, length(regexp_replace(line, '{_SP}', '', 'g')) AS chars,
         length(regexp_replace(line, '[^#*$%&|<>!]', '', 'g')) AS bad,
         length(regexp_replace(line, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS up,
         length(regexp_replace(line, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) AS letters,
         length(regexp_replace(line, '[^|»›•·]', '', 'g')) AS seps,
         lower(regexp_replace(line, '^{_SP}+|{_SP}+$', '', 'g')) AS key
  FROM l),
v AS (
  SELECT r, line, chars, 100 * bad > 10 * chars OR (letters >= 20 AND up >= 16 AND 100 * up > 80 * letters)
         OR key IN ({_NAV}) OR seps >= 3 OR {_BOIL} AS fails
  FROM f WHERE chars > 0),
s AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost,
         count(*) FILTER (WHERE fails) AS removed
  FROM v GROUP BY r),
a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(lost, 0) AS BIGINT) AS chars_removed
  FROM w LEFT JOIN rep USING (r) LEFT JOIN s USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND chars_removed <= 0.5 * word_chars AS kept
FROM a
"""
