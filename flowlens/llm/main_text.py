"""Main text of web pages: gradient-boosted trees over DOM nodes.

A lenient parser gives each page's block elements, their tree and their texts.
Every block element gets features: its tag, depth, text density and link share of
its subtree, tokens of its class, id and role, statistics of its siblings, and the
same of its ancestors.  Trees boosted on a logistic loss give each element's odds
of being article text.  Decoding is hierarchical: an element stays only if its
parent stays, and the choice with the best sum of odds, weighted by text, wins; so
no choice contradicts that of an ancestor or a descendant.

The trees are fitted on at most ``SAMPLE_PAGES`` pages (those of smallest hash
among pages of at most ``SAMPLE_CHARS`` characters).  Their labels come from pages
that say where the article is (article or main elements and the like, without the
parts named as menus, adverts and so on).  Every page is also learned from with
these names hidden, in part or in whole, so that the trees learn to judge by
density, depth, links and siblings where a page has no such names.

Texts: character references decoded, white space of a block made one space,
blocks in page order joined by two line ends.  Cases: a null or empty page, or
one without any text, has an empty text; pages may be of any length; unclosed and
stray tags are taken as they come, and a head without an end tag ends where the
body begins; without a page to learn from every block of a
page that is not named as a menu or the like stays; repeated rows are treated
alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES, SAMPLE_CHARS = 400, 200_000
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.2
#: HTML's names.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("""script style noscript template textarea title head select button svg iframe object canvas audio
    video math""".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th")}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
         "th": ("tr", "table")}
GOOD_TAGS, BAD_TAGS = ("article", "main"), ("nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset")
GOOD_NAMES = frozenset("article content post entry story main body text maincontent".split())
BAD_NAMES = frozenset("""ad ads advert adverts advertisement banner sponsor sponsored promo nav navigation navbar menu
    breadcrumb breadcrumbs header footer sidebar side aside widget related share sharing social comment comments reply
    replies cookie cookies consent notice notices alert popup modal newsletter subscribe signup login form search tags
    pagination pager copyright disclaimer toolbar complementary contentinfo""".split())
#: Names of an article among the good ones, and of comments among the bad ones.
ITEM_NAMES, COMMENT_NAMES = frozenset(("article", "entry", "post", "story")), frozenset("comment comments reply replies".split())
TAGS = ("p", "h", "li", "div", "section", "td", "ul", "pre", "blockquote", "body", *GOOD_TAGS, *BAD_TAGS)
#: Comments, declarations, end tags, and start tags as far as their first quote, "<" or ">".
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/><]*)[^>]*>|<([a-zA-Z][^\s/><]*)([^<>\"']*)", re.S)
TAG_PART, TAG_REST = re.compile(r"[>\"']"), re.compile(r"[^<>]*>")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


class Page(NamedTuple):
    tags: list[str]
    parents: list[int]          #: -1 for the root
    names: list[frozenset]      #: tokens of class, id and role
    chunks: list[tuple]         #: (run, element, in a link, text); a run is one block's text
    inside: list[int]           #: tags opened directly in each element


def parse(html: str) -> Page:
    tags, parents, names, inside, chunks = ["html"], [-1], [frozenset()], [0], []
    stack: list[tuple[str, int]] = [("html", 0)]      # open elements; inline ones carry their block
    places: dict[str, list[int]] = {}                 # where each tag, any block and any block but p is open
    run, links, hidden, at = 0, 0, 0, 0
    dead: set[int] = set()                            # places from which no unquoted ">" follows
    last = html.rfind(">") + 1                        # beyond it nothing ends a tag

    def push(tag: str, owner: int) -> None:
        for name in (tag, *(("*",) if tag in BLOCK else ()), *(("*p",) if tag in BLOCK and tag != "p" else ())):
            places.setdefault(name, []).append(len(stack))
        stack.append((tag, owner))

    def open_at(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def tag_end(begin: int) -> int:
        """Place of the ">" that ends a tag outside quotes, or -1.  Places after a quoted value
        that were passed in vain are kept, so that a page is read once at most."""
        at, passed = begin, []
        while at not in dead:
            m = TAG_PART.search(html, at)
            if m and m[0] == ">":
                return m.start()
            passed.append(at)
            close = html.find(m[0], m.end()) if m else -1
            if close < 0:
                break
            at = close + 1
        dead.update(passed)
        return -1

    def text(raw: str) -> None:
        if hidden and raw and not raw.isspace():
            leave_head("")
        if raw and not hidden:
            chunks.append((run, stack[-1][1], links > 0, unescape(raw)))

    def pop(to: int) -> None:
        nonlocal links, hidden, run
        for tag, _ in stack[to:]:
            links -= tag == "a"
            hidden -= tag in SKIP
            run += tag in BLOCK
            for name in (tag, *(("*",) if tag in BLOCK else ()), *(("*p",) if tag in BLOCK and tag != "p" else ())):
                places[name].pop()
        del stack[to:]

    def leave_head(tag: str) -> None:
        """An open head ends at its first tag or text that is no part of a head."""
        k = open_at(("head",))
        if k and (tag == "body" or (k == len(stack) - 1 and tag != "template")):
            pop(k)

    def close(wanted: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Closes the innermost of some tags, unless a limit is open inside it."""
        k = open_at(wanted)
        if k and k >= open_at(limits):
            pop(k)

    while m := MARKUP.search(html, at, last):
        text(html[at:m.start()])
        at = m.end()
        end, tag, attrs = m[1], m[2], m[3] or ""
        if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
            at = len(html)                                           # a comment without an end
            break
        if tag:
            stop = at if html[at] == ">" else -1 if html[at] == "<" else tag_end(at)
            if stop < 0 and (rest := TAG_REST.match(html, at)):     # quotes that never close
                stop = rest.end() - 1
            if stop < 0:                                             # a "<" in running text
                text(m[0])
                continue
            attrs, at = html[m.start(3):stop], stop + 1
        if end:
            end = end.lower()
            close((end,), () if end in BLOCK or end in SKIP else ("*",))
        elif tag:
            tag = tag.lower()
            if tag in ("br", "hr", "wbr") or tag in VOID:
                if tag == "hr":
                    run += 1
                elif tag == "br":
                    text(" ")
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}", re.I).search(html, at)
                at = stop.start() if stop else len(html)
                tail = html.find(">", at)
                at = tail + 1 if stop and tail >= 0 else len(html)
                continue
            if hidden:
                leave_head(tag)
            if attrs.endswith("/") and tag not in BLOCK:
                continue
            if tag in BLOCK:
                close(("p",), ("*p",))
                if tag in CLOSES:
                    close(CLOSES[tag], HOLDS[tag])
                owner = stack[-1][1]
                inside[owner] += 1
                tags.append(tag)
                parents.append(owner)
                inside.append(0)
                found = " ".join(x.strip("\"'") for x in NAMES.findall(attrs)) if attrs else ""
                names.append(frozenset(re.split(r"[^a-z0-9]+", found.lower())) - {""} if found else frozenset())
                run += 1
                push(tag, len(tags) - 1)
            else:
                inside[stack[-1][1]] += 1
                push(tag, stack[-1][1])
                links += tag == "a"
                hidden += tag in SKIP
    text(html[at:].partition("<!--")[0])
    return Page(tags, parents, names, chunks, inside)


def marks(page: Page, shown: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tags, and whether each element is itself named good or bad; elements that
    aren't ``shown`` are plain."""
    show = [True] * len(page.tags) if shown is None else shown.tolist()
    tags = [t if s or t not in GOOD_TAGS + BAD_TAGS else "div" for t, s in zip(page.tags, show)]
    good = np.array([t in GOOD_TAGS or (s and not GOOD_NAMES.isdisjoint(n)) for t, n, s in zip(tags, page.names, show)])
    bad = np.array([t in BAD_TAGS or (s and not BAD_NAMES.isdisjoint(n)) for t, n, s in zip(tags, page.names, show)])
    return tags, good, bad


def features(page: Page, shown: np.ndarray | None = None) -> np.ndarray:
    """One row per block element."""
    n = len(page.tags)
    tags, good, bad = marks(page, shown)
    parent = page.parents
    own, linked, stops, runs = (np.zeros(n) for _ in range(4))
    for run, k, link, s in page.chunks:
        size = len(s) if not s.isspace() else 0
        own[k] += size
        linked[k] += size * link
        stops[k] += s.count(".") + s.count(",") + s.count("!") + s.count("?")
        runs[k] += size > 0
    total, total_link, total_stop = own.copy(), linked.copy(), stops.copy()
    opened = np.array(page.inside, float)
    blocks, paragraphs = np.ones(n), np.array([t in ("p", "pre", "blockquote") for t in tags], float)
    children = np.zeros(n)
    for k in range(n - 1, 0, -1):
        p = parent[k]
        total[p] += total[k]
        total_link[p] += total_link[k]
        total_stop[p] += total_stop[k]
        opened[p] += opened[k]
        blocks[p] += blocks[k]
        paragraphs[p] += paragraphs[k]
        children[p] += 1
    up = np.array([0, *parent[1:]])
    depth, order, seen, in_good, in_bad, top = np.zeros(n), np.zeros(n), np.zeros(n), good.copy(), bad.copy(), np.arange(n)
    bad_depth = np.where(bad, 0.0, 99.0)
    for k in range(1, n):
        p = up[k]
        depth[k] = depth[p] + 1
        order[k] = seen[p]
        seen[p] += 1
        in_good[k] |= in_good[p]
        in_bad[k] |= in_bad[p]
        bad_depth[k] = min(bad_depth[k], bad_depth[p] + 1)
        top[k] = top[p] if tags[p] not in ("html", "body") else k
    before = np.cumsum(own) - own
    all_text = max(total[0], 1.0)
    share = lambda a, b: a / np.maximum(b, 1.0)
    columns = [depth, np.log1p(own), np.log1p(total), share(total_link, total), share(total, opened + 1), share(total_stop, total) * 100,
               np.log1p(blocks), np.log1p(paragraphs), children, order, children[up] - 1, share(total, total[up]),
               total / all_text, before / all_text, good, bad, in_good, in_bad, np.minimum(bad_depth, 9),
               share(total_link[up], total[up]), np.log1p(paragraphs[up]), share(total_link[top], total[top]),
               total[top] / all_text, np.log1p(paragraphs[top]), np.log1p(total[top]), runs]
    kind = np.array([TAGS.index("h") if t[0] == "h" and t[1:].isdigit() else TAGS.index("ul") if t == "ol" else
                     TAGS.index(t) if t in TAGS else len(TAGS) for t in tags])
    return np.column_stack([*columns, kind[:, None] == np.arange(len(TAGS)), kind[top][:, None] == np.arange(len(TAGS))])


def own_header(tag: str, names: frozenset) -> bool:
    """Whether an element inside an article is its header, and is named as nothing else bad."""
    return (tag == "header" or (tag not in BAD_TAGS and not ITEM_NAMES.isdisjoint(names))) and names & BAD_NAMES <= {"header"}


def spared(page: Page) -> np.ndarray:
    """Elements whose bad names tell of the page's layout: html and body, the only main
    of a page, and an article without another article or main (unless it is a comment)."""
    mains, articles = page.tags.count("main"), page.tags.count("article")
    return np.array([t in ("html", "body") or (t == "main" and mains == 1)
                     or (t == "article" and mains + articles == 1 and COMMENT_NAMES.isdisjoint(n))
                     for t, n in zip(page.tags, page.names)])


def labels(page: Page) -> np.ndarray | None:
    """Which elements a page that names its article has as article text."""
    _, good, bad = marks(page)
    if not good.any():
        return None
    in_good, in_bad = good.copy(), bad & ~spared(page)
    for k in range(1, len(page.tags)):
        p = page.parents[k]
        # a bad name wins over a good one and counts from there on, up to an article's own header
        in_good[k] |= in_good[p]
        in_bad[k] = (in_bad[k] and not (in_good[p] and own_header(page.tags[k], page.names[k]))) or in_bad[p]
    return in_good & ~in_bad


class Trees:
    """Boosted trees of equal depth on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.trees: list[tuple] = []
        bins = self.binned(x)
        width = BINS + 1
        flat = bins + np.arange(x.shape[1]) * width
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, width)
            for level in range(DEPTH):
                first, many = 2 ** level - 1, 2 ** level
                place = ((node - first)[:, None] * (x.shape[1] * width) + flat).ravel()
                shape = (many, x.shape[1], width)
                sum_g, sum_h = (np.bincount(place, np.repeat(v, x.shape[1]), many * x.shape[1] * width)
                                .reshape(shape).cumsum(axis=2) for v in (g, h))
                all_g, all_h = sum_g[:, :, -1:], sum_h[:, :, -1:]
                gain = sum_g ** 2 / (sum_h + 1) + (all_g - sum_g) ** 2 / (all_h - sum_h + 1) - all_g ** 2 / (all_h + 1)
                best = gain[:, :, :-1].reshape(many, -1).argmax(axis=1)
                feature[first:first + many], cut[first:first + many] = np.divmod(best, width - 1)
                node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2 ** DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2 ** DEPTH) / (np.bincount(leaf, h, 2 ** DEPTH) + 1)
            self.trees.append((feature, cut, value))
            margin += value[leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)])

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        bins, row = self.binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (bins[row, feature[node]] > cut[node])
            out += value[node - (2 ** DEPTH - 1)]
        return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which elements stay: the subtree at the root with the best sum of odds times
    (own text + 1)."""
    weight = np.ones(len(odds))
    for _, k, _, s in page.chunks:
        weight[k] += len(s.strip())
    best = odds * weight
    for k in range(len(best) - 1, 0, -1):
        best[page.parents[k]] += max(best[k], 0.0)
    stay = best > 0
    for k in range(1, len(best)):
        stay[k] &= stay[page.parents[k]]
    return stay


def text_of(page: Page, stay: np.ndarray) -> str:
    blocks: dict[int, list[str]] = {}
    for run, k, _, s in page.chunks:
        if stay[k]:
            blocks.setdefault(run, []).append(s)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def fit(htmls: list[str], seed: int = 5) -> Trees | None:
    """Trees from pages that name their article; None without one."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for html in htmls:
        page = parse(html)
        own = labels(page)
        if own is None:
            continue
        for hide in (0.0, 0.5, 1.0):
            xs.append(features(page, rng.random(len(page.tags)) >= hide))
            ys.append(own)
    return Trees(np.concatenate(xs), np.concatenate(ys).astype(float)) if xs else None


def extract_many(htmls: list[str], trees: Trees | None) -> list[str]:
    pages = [parse(h) for h in htmls]
    if trees is None:
        odds = []
        for p in pages:
            bad = marks(p)[2]
            odds.append(np.where(bad, -1e9, 1.0))
    else:
        sizes = [len(p.tags) for p in pages]
        odds = np.split(trees.odds(np.concatenate([features(p) for p in pages])), np.cumsum(sizes)[:-1]) if pages else []
    return [text_of(p, decode(p, o)) for p, o in zip(pages, odds)]


def extract_main_text(pages: DataFrame, sample: int = SAMPLE_PAGES, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # only ids meet in one place, then the few pages that they name
    place = F.xxhash64("id", "url")
    near = (rows.where(F.length("html") <= SAMPLE_CHARS).select(place.alias("place")).distinct()
            .orderBy("place").limit(sample))
    chosen = (rows.where(F.length("html") <= SAMPLE_CHARS).withColumn("place", place)
              .join(F.broadcast(near), "place").groupBy("place").agg(F.min("html").alias("html")).orderBy("place"))
    shared = pages.sparkSession.sparkContext.broadcast(fit([r["html"] for r in chosen.select("html").collect()]))

    @F.pandas_udf("string")
    def main_text(htmls: pd.Series) -> pd.Series:
        texts, part, size = [], [], 0
        for html in htmls:
            part.append(html)
            size += len(html)
            if size > 2_000_000:
                texts += extract_many(part, shared.value)
                part, size = [], 0
        return pd.Series(texts + extract_many(part, shared.value))

    out = rows.select("id", "url", main_text("html").alias("text"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                      F.length("text").cast("long").alias("n_chars"))
