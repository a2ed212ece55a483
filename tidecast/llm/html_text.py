"""Main text of web pages: page structure, and a host's suffix array for what structure leaves open.

Every page is parsed once and cut into blocks. Blocks inside `article` or `main` are the
article; menus, forms, scripts, adverts and the like are never part of it. A class or id
such as `has-sidebar` hides what an element holds, but not an `article` or `main`
in it, unless the name is that of comments, adverts or related pages; inside an article
`no-` and `without-` names hide nothing. An `article` named for comments or related
pages is none. Articles inside a form count where the page shows no other, since some
pages are one form.

What is open, the host decides: blocks of pages that mark no article, and blocks inside
an article that names like `notice`, `search` or `social` only hint at. The token streams
of what the host's pages hold outside of articles, and of hinted blocks, are concatenated,
suffixes are sorted (ranks by doubling, as deep as a run is long), and runs of at least
``RUN`` tokens that stand on ``MIN_PAGES`` distinct pages or more are repeated. Of an open
block the tokens covered by them are removed where they fill the block or form a stretch
of at least ``LONG`` tokens; shorter repeats are phrases that prose shares and stay, as do
all unique runs. A hinted block that was not repeated stays whole. Pages with the same
stream count once, so that copies of an article do not make it boilerplate. Hosts without
an open block need no suffix array: their texts do not depend on it.

A host's pages are dealt into parts of about ``PART`` pages by a hash, each with a
suffix array of its own. Where a host has more than one part, distinct pages are
counted over all of them: every part tells of each of its runs up to ``MIN_PAGES``
distinct pages (128-bit hashes of runs, 64-bit hashes of pages), and the runs that
reach ``MIN_PAGES`` in the host go back to the parts that hold them. So the number
of parts does not change a text.

Defined cases: null or empty html gives an empty text; markup cut off at the end
is dropped; repeated rows are extracted alike; null urls share the empty host;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import strings, written
from tidecast.llm.urls import host_of
from tidecast.operators.joins import sized_broadcast

RUN = 5
MIN_PAGES = 3
LONG = 20
PART = 2000

# Element names and the words in class, id or role that tell what an element is.
RAW = frozenset("script style noscript template textarea iframe svg object title".split())
NEVER = frozenset("nav footer aside form button select menu dialog head".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPEAKING = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer login menu modal nav navbar navigation newsletter notice popup promo promotion related search share sharing sidebar social sponsor sponsored subscribe widget".split())
OTHERS = frozenset("ad ads advert advertisement adverts comment comments disqus promo promotion related sponsor sponsored".split())  # may hold articles that are not the page's
HOLDING = frozenset("has no with without".split())  # the name tells what a wrapper holds, not what it is
LACKING = frozenset("no without".split())
HINTS = frozenset("copyright login menu notice search social".split())  # inside an article they may name parts of it
SPEAKING_ROLES = frozenset("banner complementary contentinfo navigation search form dialog alert".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")


def _speaks(attributes: str, inside: bool = False) -> tuple[int, bool]:
    """Whether class, id or role says that the element is not part of the article: 0 no, 1 but for an article in it, 2 with all in it; and whether it only hints so."""
    told, hint = 0, False
    for kind, *values in _NAMES.findall(attributes):
        value = "".join(values).lower()
        if kind.lower() == "role":
            if SPEAKING_ROLES.intersection(_PARTS.findall(value)):
                return 2, False
            continue
        for name in value.split():
            words = set(_PARTS.findall(name))
            if not words & SPEAKING or inside and words & LACKING:
                continue
            if inside and not words & SPEAKING - HINTS:
                hint = True
            else:
                told = max(told, 2 if words & OTHERS and not words & HOLDING else 1)
    return told, hint and not told


@dataclass(frozen=True)
class Block:
    """``inside`` an article, ``left_out`` by structure, out only because it stands in a ``form``, or inside and ``hinted`` at by a name."""

    text: str
    inside: bool
    left_out: bool
    form: bool
    hinted: bool


def parse(page: str) -> list[Block]:
    """All blocks with text, in page order."""
    out: list[Block] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # element, inside an article, left out as in _speaks, but for forms, hinted
    inside, left_out, apart, hinted = False, 0, 0, False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append(Block(text, inside, left_out > 0, left_out > 0 and not apart, hinted))
            buffer.clear()

    def pop_to(n: int) -> None:
        nonlocal inside, left_out, apart, hinted
        del stack[n:]
        inside, left_out, apart, hinted = stack[-1][1:] if stack else (False, 0, 0, False)

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            buffer.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            buffer.append(html.unescape(page[at : m.start()]))
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name == "br":
            buffer.append(" ")
        if closing:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    flush()
                    pop_to(n)
                    break
                if stack[n][0] in MAIN and name not in ("body", "html"):
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name in BLOCK and stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        hidden, hint = 0, False
        if name in NEVER or (name == "header" and not inside):
            hidden = 2
        elif attributes and name in MAIN:
            hidden = 2 if _speaks(attributes)[0] == 2 else 0  # an article that is a comment or an advert
        elif attributes and name not in ("body", "html"):
            hidden, hint = _speaks(attributes, inside)
        if name in BLOCK or hidden or hint or (stack and stack[-1][0] == name):
            if (hidden and not left_out) or (hint and not hinted):
                flush()
            shown = name in MAIN and hidden < 2
            keep = lambda own, new: 0 if shown and own < 2 else max(own, new)
            stack.append((name, inside or name in MAIN, keep(left_out, hidden), keep(apart, 0 if name == "form" else hidden), hinted or hint))
            inside, left_out, apart, hinted = stack[-1][1:]
    flush()
    return out


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article, left out by structure) of all blocks with text, in page order."""
    return [(b.text, b.inside, b.left_out) for b in parse(page)]


KEEP, OPEN, OUT = 0, 1, 2


def candidates(page: str) -> list[tuple[str, int]]:
    """(text, KEEP, OPEN or OUT) of a page's blocks: what is text, what the host decides on, and what only tells the host what it repeats."""
    found = parse(page)
    article = [b.inside and not b.left_out for b in found]
    if not any(article):
        article = [b.inside and b.form for b in found]
    if any(article):
        return [(b.text, (OPEN if b.hinted else KEEP) if own else OUT) for b, own in zip(found, article) if own or not b.inside]
    return [(b.text, OUT if b.left_out else OPEN) for b in found if not b.inside]


class Suffixes:
    """The suffix array, as deep as ``run``, of the distinct ones of some streams of token numbers."""

    def __init__(self, streams: list[list[int]], run: int = RUN):
        distinct = {tuple(s): i for i, s in reversed(list(enumerate(streams)))}
        self.streams, self.run, self.kept = streams, run, sorted(distinct.values())
        self.sizes = sizes = np.array([len(streams[i]) for i in self.kept], np.int64)
        tokens = np.concatenate([np.array([*streams[i], -1], np.int64) for i in self.kept]) if self.kept else np.zeros(0, np.int64)
        page = np.repeat(np.arange(len(self.kept)), sizes + 1)
        ends = tokens < 0
        left = np.repeat(np.cumsum(sizes + 1), sizes + 1) - 1 - np.arange(len(tokens))  # tokens up to the page's end
        tokens[ends] = tokens.max(initial=0) + 1 + np.arange(ends.sum())  # every page ends with a token of its own
        rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
        while have < run and len(rank):
            step = min(have, run - have)
            after = np.full(len(rank), -1, np.int64)
            after[: len(rank) - step] = rank[step:]
            rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            have += step
        self.order = order = np.argsort(rank, kind="stable")  # pages rise inside equal ranks
        r, p = rank[order], page[order]
        new = np.append(True, r[1:] != r[:-1])[: len(r)]
        self.new_page = new | np.append(True, p[1:] != p[:-1])[: len(r)]
        self.group = np.cumsum(new) - 1  # the run of each suffix
        self.first = np.flatnonzero(new)  # the first suffix of each run
        self.tokens, self.page, self.whole = tokens, page, left[order] >= run

    def pages(self) -> np.ndarray:
        """Distinct pages of each run."""
        return np.bincount(self.group, weights=self.new_page) if len(self.order) else np.zeros(0)

    def covered(self, runs: np.ndarray) -> list[np.ndarray]:
        """For each stream, which tokens lie in one of the runs marked in ``runs``."""
        starts = self.order[runs[self.group]] if len(self.order) else self.order
        edge = np.zeros(len(self.tokens) + self.run + 1, np.int64)
        edge[starts] += 1
        np.add.at(edge, starts + self.run, -1)
        covered = (np.cumsum(edge) > 0)[: len(self.tokens)]
        cut = np.cumsum(np.append(0, self.sizes + 1))
        by_stream = {tuple(self.streams[i]): covered[cut[k] : cut[k] + self.sizes[k]] for k, i in enumerate(self.kept)}
        return [by_stream[tuple(s)] for s in self.streams]

    def hashes(self, words: list[str]) -> np.ndarray:
        """128 bits for each run, as two columns; runs over a page's end have no meaning."""
        raw = b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words)
        of = np.concatenate([np.frombuffer(raw, np.uint64).reshape(-1, 2), np.zeros((len(self.kept) + 1, 2), np.uint64)])
        at, out = self.order[self.first], np.zeros((len(self.first), 2), np.uint64)
        for k in range(self.run):
            token = self.tokens[np.minimum(at + k, len(self.tokens) - 1)]
            out = (out ^ of[np.minimum(token, len(words))]) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def repeated(streams: list[list[int]], run: int = RUN, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """For each stream of token numbers, which tokens lie in a run of ``run`` tokens that ``min_pages`` distinct streams hold."""
    found = Suffixes(streams, run)
    return found.covered(found.pages() >= min_pages)


def _streams(pages: list[list[str]]) -> tuple[list[list[int]], list[str]]:
    """The pages' blocks as streams of token numbers, and the word of each number."""
    known: dict[str, int] = {}
    streams = [[known.setdefault(w, len(known)) for b in page for w in b.split()] for page in pages]
    return streams, list(known)


def told(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of one part (two columns of hash) with up to ``MIN_PAGES`` distinct pages (hash) of each."""
    streams, words = _streams(pages)
    found = Suffixes(streams)
    if not len(found.order):
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    texts = (" ".join(words[t] for t in streams[i]).encode("utf-8", "surrogatepass") for i in found.kept)
    names = np.array([int.from_bytes(blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts], np.int64)
    nth = np.cumsum(found.new_page)
    nth -= nth[found.first][found.group]
    tell = np.flatnonzero(found.new_page & found.whole & (nth < MIN_PAGES))
    return found.hashes(words)[found.group[tell]], names[found.page[found.order[tell]]]


def _unique(block: str, covered: np.ndarray) -> str:
    """A block without its covered stretches, if they fill it or are long."""
    if not covered.any():
        return block
    if covered.all():
        return ""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    drop = np.zeros(len(covered), bool)
    for a, z in zip(edge[::2], edge[1::2]):
        drop[a:z] = z - a >= LONG
    return " ".join(w for w, d in zip(block.split(), drop) if not d) if drop.any() else block


def unique_texts(pages: list[list[str]], shared: np.ndarray | None = None) -> list[list[str]]:
    """For the pages of one host, or of one part and the runs ``shared`` in its host, what stays of each of their blocks."""
    streams, words = _streams(pages)
    found = Suffixes(streams)
    runs = found.pages() >= MIN_PAGES
    if shared is not None and len(shared) and len(runs):
        pair = np.dtype([("h1", np.int64), ("h2", np.int64)])
        own = np.ascontiguousarray(found.hashes(words)).view(pair)[:, 0]
        runs |= np.isin(own, np.ascontiguousarray(shared, np.int64).view(pair)[:, 0]) & found.whole[found.first]
    out = []
    for page, covered in zip(pages, found.covered(runs)):
        stay, at = [], 0
        for b in page:
            n = len(b.split())
            stay.append(_unique(b, covered[at : at + n]))
            at += n
        out.append(stay)
    return out


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, host, open, text, blocks, kinds), written: the text where nothing is open, and the blocks that a host may need."""

    def run(batches):
        for b in batches:
            rows = []
            for i, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2))):
                found = candidates(page or "")
                undecided = any(k == OPEN for _, k in found)
                text = None if undecided else "\n".join(t for t, k in found if k == KEEP)
                # an article that is settled is no one's evidence
                rest = [(t, k) for t, k in found if undecided or k != KEEP]
                rows.append((i, url, undecided, text, [t for t, _ in rest], [k for _, k in rest]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [b.column(0).type, pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "url", "open", "text", "blocks", "kinds"])

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    own = f"page_id {dict(narrow.dtypes)['page_id']}, url string, open boolean, text string, blocks array<string>, kinds array<int>"
    return written(narrow.mapInArrow(run, own).withColumn("host", host_of(F.col("url"))), "page-blocks")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", part: int = PART) -> DataFrame:
    """(page_id, url, text): one row for each row of ``pages``."""
    parsed = _parsed(pages, id_col, url_col, html_col)
    decided = parsed.where("NOT open").select("page_id", "url", "text")
    hosts = parsed.groupBy("host").agg(F.ceil(F.count("*") / part).alias("parts"), F.max("open").alias("asked")).where("asked").drop("asked")
    evidence = parsed.where(F.size("blocks") > 0).select("page_id", "url", "open", "blocks", "kinds", "host")
    dealt = evidence.join(sized_broadcast(hosts), "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url", "blocks"), F.col("parts")))

    def streams(rows: pd.DataFrame) -> list[list[str]]:
        """What a page tells of its host: all but the article itself."""
        return [[t for t, k in zip(page, kinds) if k != KEEP] for page, kinds in zip(rows["blocks"], rows["kinds"])]

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        host, part, parts = rows[["host", "part", "parts"]].iloc[0]
        runs, names = told(streams(rows) if parts > 1 else [])
        return pd.DataFrame({"host": np.full(len(runs), host, object), "part": np.full(len(runs), part, np.int64), "h1": runs[:, 0], "h2": runs[:, 1], "page": names})

    def decide(rows: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        texts = []
        for page, kinds, stay in zip(rows["blocks"], rows["kinds"], unique_texts(streams(rows), shared[["h1", "h2"]].to_numpy(np.int64))):
            rest = iter(stay)
            own = [t if k == KEEP else next(rest) for t, k in zip(page, kinds)]
            texts.append("\n".join(t for t, k in zip(own, kinds) if t and k != OUT))
        return rows.assign(text=texts)[rows["open"]][["page_id", "url", "text"]]

    dealt = dealt.repartition("host", "part")  # else the join's partitioning by host would keep a host's parts in one task
    runs = dealt.groupBy("host", "part").applyInPandas(tell, "host string, part long, h1 long, h2 long, page long")
    counted = runs.repartition("host", "h1", "h2").groupBy("host", "h1", "h2").agg(F.collect_set("page").alias("pages"), F.collect_set("part").alias("held"))
    shared = counted.where(F.size("pages") >= MIN_PAGES).select("host", F.explode("held").alias("part"), "h1", "h2")
    return decided.unionAll(dealt.groupBy("host", "part").cogroup(shared.groupBy("host", "part")).applyInPandas(decide, decided.schema))
