"""Query op5: every participant's view of all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.chat import rotate
from tidecast.llm.common import table

NAME = "op5_chat_rotation"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH b AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS role, coalesce(text, '') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, body) - 1 AS place FROM b),
r AS (SELECT *, CAST(floor(place / 1024) AS BIGINT) AS block FROM n),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
h AS (
  SELECT conv_id, speaker, block, place, role = speaker AS own, body,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head
  FROM r JOIN s USING (conv_id)),
p AS (SELECT *, head || replace(body, '<|', '< |') || '<|end|>' || chr(10) AS part FROM h),
a AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY conv_id, speaker, block ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p),
m AS (SELECT *, CAST(off + length(head) AS BIGINT) AS a0, CAST(off + length(part) - 1 AS BIGINT) AS a1 FROM a)
SELECT conv_id, speaker, block, count(*) AS n_messages, string_agg(part, '' ORDER BY place) AS text,
       coalesce(string_agg(a0 || '-' || a1, ',' ORDER BY place) FILTER (WHERE own), '') AS masks,
       CAST(sum(CASE WHEN own THEN a1 - a0 ELSE 0 END) AS BIGINT) AS n_trained
FROM m GROUP BY conv_id, speaker, block
"""
