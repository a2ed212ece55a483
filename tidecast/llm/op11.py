"""Query op11: fill-in-middle over all documents, with digests of outputs and of the texts restored from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import table
from tidecast.llm.infill import restore, transform

NAME = "op11_fill_in_middle"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(transform(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (
  SELECT doc_id, t, list_transform(generate_series(0, 3), lambda k: CAST('0x' || substr(s, CAST(8 * k + 1 AS INTEGER), 8) AS BIGINT)) AS h,
         CASE WHEN t = '' THEN [] WHEN ends_with(t, chr(10)) THEN list_transform(list_slice(string_split(t, chr(10)), 1, -2), lambda x: x || chr(10))
              ELSE list_concat(list_transform(list_slice(string_split(t, chr(10)), 1, -2), lambda x: x || chr(10)), [list_extract(string_split(t, chr(10)), -1)]) END AS units
  FROM d),
k AS (
  SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT doc_id, t, n, form, CASE WHEN a = 0 THEN '' ELSE array_to_string(list_slice(units, 1, a), '') END AS prefix,
         CASE WHEN a = b THEN '' ELSE array_to_string(list_slice(units, a + 1, b), '') END AS middle,
         CASE WHEN b = n THEN '' ELSE array_to_string(list_slice(units, b + 1, n), '') END AS suffix
  FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
