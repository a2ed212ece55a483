"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``span`` consecutive words of a benchmark item (an item of fewer words
is one window). Of every window the least k-gram hash is kept; equal windows keep
equal minima, so a shared window is never missed. Documents' minima are joined
with the items', and each match is extended to its whole window and compared word
by word, so that only true shared spans count.

Matching hashes are taken of words in full lower case, a superset of what the
comparison (A-Z lower-cased only) lets pass.

The items' minima are broadcast only if at most ``BROADCAST`` of them exist.
Beyond it the join shuffles narrow rows (document, place, hash) and only the
places that match meet their texts again.

Defined cases: null, empty or wordless texts have no words and no hits; items
without words have no windows; an item without an id hits words but is not
counted among the items; rows of one id are judged by their own text, and equal
rows alike; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import lower_ascii, numbered, written

SPAN = 10
GRAM = 4
BROADCAST = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, NOT_WORD), ""), F.array().cast("array<string>"))


def _slide(df: DataFrame, name: str, wide: int, join: Callable[[Column, Column], Column]) -> DataFrame:
    """Make ``name`` hold, at each place, ``join`` over ``wide`` neighbours: widths double, so each step is one zip."""
    have = 1
    while have < wide:
        step = min(have, wide - have)
        a = F.col(name)
        df = df.withColumn(name, F.zip_with(a, F.slice(a, F.lit(step + 1), F.greatest(F.size(a), F.lit(1))), join))
        have += step
    return df


def minima(df: DataFrame, span: int, gram: int = GRAM) -> DataFrame:
    """Add ``least``: the least gram hash of every window of ``span`` of the array ``words``."""
    k = min(gram, span)
    spelled = F.transform("words", lambda w: F.xxhash64(F.replace(F.lower(w), F.lit("ς"), F.lit("σ"))))
    df = df.withColumn("least", spelled)
    df = _slide(df, "least", k, lambda a, b: F.xxhash64(a, b))
    df = _slide(df, "least", span - k + 1, lambda a, b: F.least(a, b))
    return df.withColumn("least", F.slice("least", F.lit(1), F.greatest(F.size("words") - (span - 1), F.lit(0))))


def _window_text(start: Column, span: int) -> Column:
    return lower_ascii(F.concat_ws(" ", F.slice("words", start + 1, F.lit(span))))


# posexplode_outer below: for the inner form the optimizer adds a filter on the array's size and pushes it, with all
# steps spelled out, under the steps themselves. Rows without a window have a null hash and meet nothing.


def item_windows(items: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """(item_id, span, hash, window) of all items; span is the item's own if it has fewer words."""
    split = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("words"))
    split = split.withColumn("n", F.size("words")).where("n > 0")
    out = None
    for m in range(1, span + 1):
        own = minima(split.where(F.col("n") == m if m < span else F.col("n") >= m), m)
        rows = own.select("item_id", "words", F.posexplode_outer("least").alias("at", "hash"))
        rows = rows.where("hash IS NOT NULL").select("item_id", F.lit(m).alias("span"), "hash", _window_text(F.col("at"), m).alias("window"))
        out = rows if out is None else out.unionAll(rows)
    return out.distinct()


def shared_windows(docs: DataFrame, windows: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, tie, at, span, window): places in ``docs`` (doc_id, tie, words) where an item's window stands.

    ``windows`` is a written table of item_windows().
    """
    grams = written(windows.select("span", "hash").distinct(), "gram-minima")
    spans = {r["span"]: r["count"] for r in grams.groupBy("span").count().collect()}  # at most SPAN rows
    texts = windows.select("span", "window").distinct()
    out = docs.select("doc_id", "tie", F.lit(0).alias("at"), F.lit(0).alias("span"), F.lit("").alias("window")).where("false")
    for m, n in sorted(spans.items()):
        own = grams.where(F.col("span") == m).select(F.col("hash").alias("own"))
        placed = minima(docs, m)
        if n <= broadcast:
            rows = placed.select("doc_id", "tie", "words", F.posexplode_outer("least").alias("at", "hash"))
            met = rows.join(F.broadcast(own), F.col("hash") == F.col("own"))
        else:
            rows = placed.select("doc_id", "tie", F.posexplode_outer("least").alias("at", "hash"))
            met = rows.join(own, F.col("hash") == F.col("own")).groupBy("doc_id", "tie").agg(F.collect_set("at").alias("places"))
            met = met.select(F.col("doc_id").alias("own_id"), F.col("tie").alias("own_tie"), "places")
            same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tie") == F.col("own_tie"))
            met = docs.join(met, same).select("doc_id", "tie", "words", F.explode("places").alias("at"))
        found = met.select("doc_id", "tie", "at", F.lit(m).alias("span"), _window_text(F.col("at"), m).alias("window"))
        out = out.unionAll(found.join(texts, ["span", "window"], "left_semi").select("doc_id", "tie", "at", "span", "window"))
    return out.distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, broadcast: int = BROADCAST) -> DataFrame:
    """(doc_id, tie, n_words, n_hit, n_items, items, contaminated): one row for each row of ``docs``; ``tie`` is a hash of its text."""
    windows = written(item_windows(items, item_id, item_text, span), "item-windows")
    text = F.col(text_col).cast("string")
    split = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"), words(text).alias("words"))
    hits = written(shared_windows(split, windows, broadcast), "shared-windows")

    by_place = Window.partitionBy("doc_id", "tie").orderBy("at", "span")
    end = F.col("at") + F.col("span")
    before = F.coalesce(F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.withColumn("end", end).withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("at", before)))
    n_hit = spans.groupBy("doc_id", "tie").agg(F.sum("new").alias("n_hit"))
    named = hits.select("doc_id", "tie", "span", "window").distinct().join(windows.select("span", "window", "item_id").where("item_id IS NOT NULL").distinct(), ["span", "window"])
    found = named.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = n_hit.select(F.col("doc_id").alias("own_id"), F.col("tie").alias("own_tie"), "n_hit")
    found = found.select(F.col("doc_id").alias("item_doc"), F.col("tie").alias("item_tie"), "items")
    both = both.join(found, F.col("own_id").eqNullSafe(F.col("item_doc")) & (F.col("own_tie") == F.col("item_tie")), "left")
    all_docs = split.select("doc_id", "tie", F.size("words").cast("long").alias("n_words"))
    joined = all_docs.join(both, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tie") == F.col("own_tie")), "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    return joined.select("doc_id", "tie", "n_words", hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns."""
    names = docs.columns
    plain = numbered(docs)
    own_id, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    found = contamination(plain, items, own_id, text, **more).where("contaminated")
    bad = found.select(F.col("doc_id").alias("bad_id"), F.col("tie").alias("bad_tie")).distinct()
    same = F.col(own_id).eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("bad_tie"))
    return plain.join(bad, same, "left_anti").toDF(*names)
