"""URL filter: rules first, then a path-template tree for each host. DataFrame operations only.

Rules (action, host, path) decide the urls they fit, longest rule first. The
urls that rules decide are the labelled ones from which templates are judged:

1. Segments that look variable (numbers, hexadecimal ids, dates, long slugs) become wildcards.
2. A node of the tree with many children that are hardly repeated makes its child segment a wildcard.
3. Sibling branches that differ in one segment are merged if their labelled shares
   differ no more than chance explains (two-sided z-test against all siblings).
   Steps 2 and 3 go on with the generalised tree until nothing changes; every change
   makes one more segment a wildcard, so a tree needs few rounds beyond its depth.
4. A template's purity is its labelled share of allowed urls, smoothed towards its
   host, which is smoothed towards the same template on all hosts and that towards
   all urls. Templates below ``MIN_PURITY`` are rejected.

Everything works on grouped templates, pre-aggregated before any shuffle, so a
host with a third of all urls is a few rows.

Defined cases: a null url, or one without `://`, has an empty host and path and
meets no rule; its template is `/` of the empty host; repeated rows are judged
alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import lower_ascii, written

# The rules of the contract (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

NUMBER = r"[0-9]+"
HEXADECIMAL = r"(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}"
DATE = r"[0-9]{4}[-_.][0-9]{1,2}([-_.][0-9]{1,2})?"
SLUG = r"[^-]+(-[^-]+){3,}|.{32,}"
MIN_CHILDREN = 20
MAX_REPEAT = 3  # urls for each child, at most, of a node whose children are variable
Z = 2.0
STRENGTH = 5.0
MIN_PURITY = 0.5


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments, those that look variable as wildcards; a file ending stays."""
    stem = r"(?i)(\.[a-z0-9]{1,5})?$"

    def general(s: Column) -> Column:
        out = s
        for pattern, mark in ((SLUG, "{s}"), (HEXADECIMAL, "{x}"), (DATE, "{d}"), (NUMBER, "{n}")):
            out = F.when(s.rlike(rf"(?s)^({pattern}){stem}"), F.concat(F.lit(mark), F.lower(F.regexp_extract(s, r"(?i)\.[a-z0-9]{1,5}$", 0)))).otherwise(out)
        return out

    return F.transform(F.array_remove(F.split(path, "/"), ""), general)


def _variable_nodes(t: DataFrame) -> DataFrame:
    """Replace child segments of nodes with many rarely repeated children by `*`; ``t`` has host, segs, wild, n, labelled, bad."""
    each = t.groupBy("host", "wild").agg(F.sum("n").alias("n"))
    nodes = each.select("host", "wild", "n", F.posexplode("wild").alias("i", "seg"))
    nodes = nodes.select("host", F.array_join(F.slice("wild", F.lit(1), F.col("i")), "/").alias("parent"), "i", "wild", "seg", "n")
    plain = ~F.col("seg").startswith("{") & (F.col("seg") != "*")
    children = nodes.where(plain).groupBy("host", "i", "parent", "seg").agg(F.sum("n").alias("n"))
    wide = children.groupBy("host", "i", "parent").agg(F.count("*").alias("children"), F.sum("n").alias("n"))
    wide = wide.where((F.col("children") >= MIN_CHILDREN) & (F.col("n") <= MAX_REPEAT * F.col("children"))).select("host", "i", "parent", F.lit("*").alias("mark"))
    marked = nodes.join(wide, ["host", "i", "parent"], "left")
    marked = marked.withColumn("seg", F.when(F.col("mark").isNotNull() & plain, F.col("mark")).otherwise(F.col("seg")))
    again = marked.groupBy("host", "wild").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "seg"))), lambda x: x["seg"]).alias("new"))
    joined = t.join(again, ["host", "wild"], "left")
    return joined.select("host", "segs", F.coalesce("new", "wild").alias("wild"), "n", "labelled", "bad")


def _merged(t: DataFrame) -> DataFrame:
    """(host, wild, template): siblings with like labelled shares become one template; ``t`` has host, wild, labelled, bad."""
    each = t.groupBy("host", "wild").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    spread = each.select("host", "wild", "labelled", "bad", F.posexplode("wild").alias("i", "seg")).where(~F.col("seg").startswith("{") & (F.col("seg") != "*"))
    masked = F.concat(F.slice("wild", F.lit(1), F.col("i")), F.array(F.lit("*")), F.slice("wild", F.col("i") + 2, F.size("wild")))
    spread = spread.select("host", "wild", "labelled", "bad", "i", masked.alias("masked"))
    pooled = spread.groupBy("host", "i", "masked").agg(F.count("*").alias("siblings"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad")).where("siblings > 1")
    met = spread.join(pooled, ["host", "i", "masked"])
    share = F.col("all_bad") / F.col("all_labelled")
    apart = F.abs(F.col("bad") / F.col("labelled") - share) > Z * F.sqrt(share * (1 - share) / F.col("labelled"))
    alike = met.where((F.col("labelled") == 0) | ~F.when(F.col("labelled") > 0, apart).otherwise(F.lit(False)))
    best = alike.groupBy("host", "wild").agg(F.min_by("masked", "i").alias("masked"))
    return each.join(best, ["host", "wild"], "left").select("host", "wild", F.coalesce("masked", "wild").alias("template"))


def template_tree(grouped: DataFrame) -> DataFrame:
    """(host, segs, wild, n, labelled, bad): each path's template, generalised until nothing changes; ``grouped`` lacks wild."""
    tree = written(grouped.withColumn("wild", F.col("segs")), "url-templates")
    while True:
        wide = written(_variable_nodes(tree), "url-nodes")
        after = written(wide.join(_merged(wide), ["host", "wild"]).select("host", "segs", F.col("template").alias("wild"), "n", "labelled", "bad"), "url-named")
        both = tree.select("host", "segs", F.col("wild").alias("old")).join(after, ["host", "segs"])
        if not both.where(F.col("old") != F.col("wild")).limit(1).count():
            return after
        tree = after


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity): one row for each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("segs", segments(F.col("path")))
    bad = F.when(F.col("found.action") == "block", 1).otherwise(0)
    grouped = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("found.action").alias("labelled"), F.sum(bad).alias("bad"))
    named = template_tree(grouped).select("host", "segs", F.col("wild").alias("template"), "labelled", "bad")

    def rate(n: str, parent: Column) -> Column:
        return (F.col(f"{n}_bad") + STRENGTH * parent) / (F.col(f"{n}_labelled") + STRENGTH)

    def sums(n: str, *keys: str) -> DataFrame:
        return named.groupBy(*keys).agg(F.sum("labelled").alias(f"{n}_labelled"), F.sum("bad").alias(f"{n}_bad"))

    total = named.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("all_rate"))
    own = sums("own", "host", "template").join(sums("host", "host"), "host").join(sums("like", "template"), "template").crossJoin(F.broadcast(total))  # total: one row
    own = own.withColumn("like_rate", rate("like", F.col("all_rate"))).withColumn("host_rate", rate("host", F.col("like_rate")))
    own = own.select("host", "template", (1 - rate("own", F.col("host_rate"))).alias("purity"))
    verdicts = written(named.select("host", "segs", "template").join(own, ["host", "template"]), "url-verdicts")
    joined = rows.join(verdicts, ["host", "segs"])
    verdict = F.coalesce("found.action", F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "found.rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("purity", 9).alias("purity"))
