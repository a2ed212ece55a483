"""Query op6: verdicts on the urls of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import LOWER, UPPER, table
from tidecast.llm.urls import DATE, HEXADECIMAL, NUMBER, RULES, SLUG, judge_urls

NAME = "op6_url_filter"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _case(column: str) -> str:
    fits = [(len(h + p), f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if column == 'rule' else a}'") for a, h, p in RULES]
    return "CASE " + " ".join(x for _, x in sorted(fits, reverse=True)) + " END"


def _general() -> str:
    end = r"(\.[a-zA-Z0-9]{1,5})?$"
    # RE2 has no look-ahead: a digit is asked for beside the hexadecimal pattern
    plain_hex = HEXADECIMAL.replace("(?=[0-9a-fA-F-]*[0-9])", "")
    tests = ((NUMBER, "{n}", ""), (DATE, "{d}", ""), (plain_hex, "{x}", rf" AND regexp_matches(s, '^[0-9a-fA-F-]*[0-9]')"), (SLUG, "{s}", ""))
    return "CASE " + " ".join(rf"WHEN regexp_matches(s, '(?s)^({p}){end}'){more} THEN '{m}' || lower(regexp_extract(s, '\.[a-zA-Z0-9]{{1,5}}$'))" for p, m, more in tests) + " ELSE s END"


ROUNDS = 6  # of the SQL; rounds after the last change change nothing


def _round(k: int) -> str:
    """One round of the tree: tr{k} has host, segs, wild, n, labelled, bad."""
    return f"""
ev{k} AS (SELECT host, wild, sum(n) AS n FROM tr{k} GROUP BY ALL),
nd{k} AS (SELECT host, wild, n, unnest(wild) AS seg, unnest(range(0, len(wild))) AS i FROM ev{k}),
nn{k} AS (SELECT *, array_to_string(list_slice(wild, 1, i), '/') AS parent, NOT starts_with(seg, '{{') AND seg <> '*' AS plain FROM nd{k}),
ch{k} AS (SELECT host, i, parent, seg, sum(n) AS n FROM nn{k} WHERE plain GROUP BY ALL),
wd{k} AS (SELECT host, i, parent, '*' AS mark FROM ch{k} GROUP BY host, i, parent HAVING count(*) >= 20 AND sum(n) <= 3 * count(*)),
mk{k} AS (SELECT a.host, wild, a.i, CASE WHEN mark IS NOT NULL AND plain THEN mark ELSE seg END AS seg FROM nn{k} a LEFT JOIN wd{k} b ON a.host = b.host AND a.i = b.i AND a.parent = b.parent),
ag{k} AS (SELECT host, wild, list(seg ORDER BY i) AS new FROM mk{k} GROUP BY host, wild),
tv{k} AS (SELECT t.host, segs, coalesce(new, t.wild) AS wild, n, labelled, bad FROM tr{k} t LEFT JOIN ag{k} a ON t.host = a.host AND t.wild = a.wild),
ea{k} AS (SELECT host, wild, sum(labelled) AS labelled, sum(bad) AS bad FROM tv{k} GROUP BY ALL),
sp{k} AS (SELECT *, unnest(wild) AS seg, unnest(range(0, len(wild))) AS i FROM ea{k}),
sm{k} AS (SELECT host, wild, labelled, bad, i, list_concat(list_concat(list_slice(wild, 1, i), ['*']), list_slice(wild, i + 2, len(wild))) AS masked FROM sp{k} WHERE NOT starts_with(seg, '{{') AND seg <> '*'),
po{k} AS (SELECT host, i, masked, sum(labelled) AS al, sum(bad) AS ab FROM sm{k} GROUP BY ALL HAVING count(*) > 1),
me{k} AS (SELECT a.*, CASE WHEN labelled > 0 THEN abs(bad / labelled - ab / al) > 2.0 * sqrt(greatest(0, (ab / al) * (1 - ab / al) / labelled)) ELSE false END AS apart FROM sm{k} a JOIN po{k} USING (host, i, masked)),
be{k} AS (SELECT host, wild, arg_min(masked, i) AS masked FROM me{k} WHERE NOT apart GROUP BY ALL),
tr{k + 1} AS (SELECT t.host, segs, coalesce(masked, t.wild) AS wild, n, labelled, bad FROM tv{k} t LEFT JOIN be{k} b ON t.host = b.host AND t.wild = b.wild),"""


SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT r, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
f AS (SELECT *, {_case('rule')} AS rule, {_case('action')} AS action, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {_general()}) AS segs FROM p),
g AS (SELECT host, segs, count(*) AS n, count(action) AS labelled, count(*) FILTER (WHERE action = 'block') AS bad FROM f GROUP BY ALL),
tr0 AS (SELECT host, segs, segs AS wild, n, labelled, bad FROM g),{"".join(map(_round, range(ROUNDS)))}
nm AS (SELECT host, segs, wild AS template, labelled, bad FROM tr{ROUNDS}),
al AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(labelled), 0) + 2) AS rate FROM nm),
lk AS (SELECT template, (sum(bad) + 5.0 * any_value(rate)) / (sum(labelled) + 5.0) AS rate FROM nm, al GROUP BY template),
hs AS (SELECT host, CAST(sum(labelled) AS DOUBLE) AS hl, CAST(sum(bad) AS DOUBLE) AS hb FROM nm GROUP BY host),
ow AS (SELECT host, template, CAST(sum(labelled) AS DOUBLE) AS ol, CAST(sum(bad) AS DOUBLE) AS ob FROM nm GROUP BY ALL),
pu AS (SELECT host, template, 1 - (ob + 5.0 * ((hb + 5.0 * rate) / (hl + 5.0))) / (ol + 5.0) AS purity FROM ow JOIN hs USING (host) JOIN lk USING (template)),
vd AS (SELECT nm.host, segs, template, purity FROM nm JOIN pu USING (host, template))
SELECT page_id, f.host, path, rule, coalesce(action, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(template, '/') AS template, round(purity, 9) AS purity
FROM f JOIN vd ON f.host = vd.host AND f.segs = vd.segs
"""
