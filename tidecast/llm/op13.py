"""Query op13: five filters of documents in all 120 orders, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.audit import CopyFilter, TextFilter, audit
from tidecast.llm.common import UPPER, table

NAME = "op13_filter_audit"

# The failure conditions.
SYMBOLS = b"#$%&*|"
FILTERS = [
    TextFilter("A", lambda t: len(t.words) < 200),
    TextFilter("B", lambda t: 100 * len(set(t.words)) < 50 * len(t.words)),
    TextFilter("C", lambda t: 100 * t.count(UPPER.encode()) > 3 * len(t.text)),
    TextFilter("D", lambda t: t.count(SYMBOLS) > 0),
    CopyFilter("E"),
]
LOSSES = {"good_lost": "quality = 1", "toxic_lost": "toxic = 1"}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), FILTERS, LOSSES, part_col="lang")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT r, doc_id, part,
         (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN coalesce(first < doc_id, false) THEN 16 ELSE 0 END) AS fails
  FROM w),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
a AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(lab.toxic), 0) AS toxic
  FROM m LEFT JOIN lab ON m.doc_id = lab.doc_id GROUP BY part, fails),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS own, CAST(coalesce(list_sum(list_slice(bits, 1, k - 1)), 0) AS INTEGER) AS before
  FROM o, range(1, 6) AS x(k)),
c AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails & own <> 0 AND fails & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM a, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c
"""
