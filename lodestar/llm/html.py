"""Main text of web pages by maximum-scoring subsequence.

A page becomes units: runs of words, tags, and whole boilerplate elements (menus, forms, adverts and
the like). Words score positive and tags and boilerplate negative; one linear scan finds the
contiguous region with the best sum. The weights come from pages that label their content themselves
with an article or main element: an averaged structured perceptron moves them until the best region
is the labelled one. About ``TRAIN_PAGES`` labelled pages of at most ``TRAIN_CHARS`` characters,
chosen by a hash of the page, are used; extraction covers all pages, whole, in linear time.

Inside the region boilerplate elements are left out; an element that is never closed is only a
boundary. Null and empty pages have the text ''. Pages are independent: repeated rows, equal ids and
null addresses don't matter; of regions of equal sums the first counts; columns of other names are
ignored. Without labelled pages the weights are ``PRIOR``. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, slices

TRAIN_PAGES, TRAIN_CHARS, ROUNDS = 400, 50_000, 4
#: Weights before training; any other tag starts at ``OTHER``.
PRIOR = {"word": 1.0, "linked": 0.3, "a": -0.5, "/a": 0.0, "p": -0.1, "/p": -0.1, "br": -0.1, "b": -0.1, "/b": -0.1, "li": -1.0, "ul": -1.0, "div": -2.0, "/div": -2.0, "td": -1.0, "tr": -1.0, "table": -2.0, "section": -2.0, "/section": -2.0, "body": -5.0, "/body": -5.0}
OTHER, BOILERPLATE = -0.5, -2.0
HIGHEST_TAG = -0.01

#: Attributes: unquoted parts hold no angle brackets and quoted ones are of bounded length, so that a tag
#: that never ends is given up at the next bracket and a page of such takes linear time.
ATTRIBUTES = r"(?:[^<>\"']++|\"[^\"]{0,5000}+\"|'[^']{0,5000}+')*+"
UNIT = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b{ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)({ATTRIBUTES})>|<[!?][^<>]*+>|[^<]++|<", re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

#: Elements that are never main text, names that mark such elements, elements that
#: are never left out for their names, elements inside a line, and elements without an end tag.
LEFT_OUT = frozenset("head nav aside footer form button select dialog menu object video audio canvas".split())
NAMES = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond share sharing social related footer masthead popup modal newsletter subscribe widget toolbar pagination pager login signup search".split())
#: Parts that make no other thing of such a name: share-buttons is sharing, share-price is not.
PLAIN = frozenset("area article articles bar block body bottom box buttons container content entry form group header holder icons inner item items left links list main outer page panel post posts primary reader region right row secondary section site slot stories text title top unit user wrap wrapper zone".split())
HEADERS = frozenset(("header", "site-header", "page-header", "banner"))
COMMENTS = frozenset("comment comments disqus reply replies".split())
SIZE = re.compile("[0-9]+(?:x[0-9]+)?")
NEVER = frozenset("html body article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Unit:
    """kind: word, tag or left (out); name: the weight's; text: a run of words or a tag's name."""

    __slots__ = ("kind", "name", "size", "text")

    def __init__(self, kind: str, name: str, text: str = "", size: int = 1):
        self.kind, self.name, self.text, self.size = kind, name, text, size


def names_it(name: str, among: frozenset[str]) -> bool:
    """Whether a class or id names one of those, and its other parts nothing else."""
    parts = [x for x in re.split(r"[_-]+", name) if x]
    return any(x in among for x in parts) and all(x in among or x in NAMES or x in PLAIN or SIZE.fullmatch(x) for x in parts)


def left_out(tag: str, attributes: str, depth: int) -> str:
    """The reason's name, if an element is boilerplate; depth: of article or main elements around it."""
    if tag in LEFT_OUT:
        return tag
    if tag in VOID or tag in NEVER and tag != "article":
        return ""
    if tag == "header":
        return "" if depth else "header"
    for values in NAMED.findall(attributes) if "=" in attributes else ():
        for name in "".join(values).lower().split():
            if name in HEADERS and not depth and tag != "article" or names_it(name, COMMENTS if tag == "article" else NAMES):
                return f"{tag}.{name}"
    return ""


def units(page: str) -> list[Unit]:
    found = list(UNIT.finditer(page))
    ends: dict[int, int] = {}  # of elements, by the place of their start tags
    opened: dict[str, list[int]] = defaultdict(list)
    for k, m in enumerate(found):
        if m[3] and (tag := m[3].lower()) not in VOID:
            if not m[2]:
                opened[tag].append(k)
            elif opened[tag]:
                ends[opened[tag].pop()] = k
    out, k, depth, links = [], 0, 0, 0
    while k < len(found):
        m = found[k]
        if m[3]:
            tag, close = m[3].lower(), m[2]
            if not close and (reason := left_out(tag, m[4], depth)):
                out.append(Unit("left", f"left {reason}", tag))
                k = ends.get(k, k) + 1
                continue
            step = -1 if close else 1
            depth = max(0, depth + step * (tag in ("article", "main")))
            links = max(0, links + step * (tag == "a"))
            out.append(Unit("tag", close + tag, tag))
        elif m[0][0] != "<" or m[0] == "<":
            if n := len(m[0].split()):
                out.append(Unit("word", "linked" if links else "word", m[0], n))
            else:
                out.append(Unit("space", "", m[0]))
        k += 1
    return out


def start_weight(name: str) -> float:
    return PRIOR.get(name, BOILERPLATE if name.startswith("left ") else OTHER)


def region(page: list[Unit], weights: dict[str, float]) -> tuple[int, int]:
    """First and last unit of the contiguous region with the best sum; it begins and ends with words."""
    best, span, total, start = 0.0, (0, -1), 0.0, None
    for k, u in enumerate(page):
        if u.kind == "space":
            continue
        if u.kind == "word" and (start is None or total <= 0):
            total, start = 0.0, k
        if start is None:
            continue
        weight = weights.get(u.name)
        total += (start_weight(u.name) if weight is None else weight) * u.size
        if u.kind == "word" and total > best:
            best, span = total, (start, k)
    return span


def labelled(page: list[Unit]) -> tuple[int, int] | None:
    """The words of the first article, or else main element."""
    for tag in ("article", "main"):
        start = next((k for k, u in enumerate(page) if u.kind == "tag" and u.name == tag), None)
        end = next((k for k in range(len(page) - 1, -1, -1) if page[k].kind == "tag" and page[k].name == "/" + tag), None)
        if start is not None and end is not None:
            words = [k for k in range(start, end) if page[k].kind == "word"]
            if words:
                return words[0], words[-1]
    return None


def train(pages: list[str]) -> dict[str, float]:
    """Averaged perceptron: add the labelled region's units, take away the best region's; signs stay."""
    ready = [(u, gold) for u in map(units, pages) if (gold := labelled(u))]
    ready.sort(key=lambda x: [(u.name, u.text) for u in x[0]])  # the rows' order isn't given
    weights: dict[str, float] = {n: start_weight(n) for u, _ in ready for n in {x.name for x in u if x.kind != "space"}}
    sums: dict[str, float] = defaultdict(float)
    for _ in range(ROUNDS):
        for page, gold in ready:
            guess = region(page, weights)
            if guess != gold:
                step: dict[str, int] = defaultdict(int)
                for (a, b), sign in ((gold, 1), (guess, -1)):
                    for u in page[a : b + 1]:
                        if u.kind in ("tag", "left"):
                            step[u.name] += sign
                for name, s in step.items():
                    if s:
                        weights[name] = min(HIGHEST_TAG, weights[name] + (2 if s > 0 else -2))
            for name, w in weights.items():
                sums[name] += w
    return {name: s / (ROUNDS * len(ready)) for name, s in sums.items()}


def main_text(page: str, weights: dict[str, float]) -> str:
    whole = units(page)
    first, last = region(whole, weights)
    blocks, now = [], []
    for u in whole[first : last + 1]:
        if u.kind in ("word", "space"):
            now.append(u.text)
        elif u.text not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return " ".join(w for b in blocks for w in entities.unescape(b).split())


def training_pages(pages: DataFrame) -> list[str]:
    """About ``TRAIN_PAGES`` marked pages by their hash, twice as many at most; no page travels but those."""
    marked = pages.where(F.col("html").isNotNull() & (F.length("html") <= TRAIN_CHARS) & F.lower("html").rlike("<(article|main)[ >]"))
    every = max(1, marked.count() // TRAIN_PAGES)
    chosen = marked.where(F.pmod(F.xxhash64("url", "page_id", "html"), F.lit(every)) == 0).limit(4 * TRAIN_PAGES)
    return [r["html"] for r in chosen.select("html").collect()]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = train(training_pages(plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p or "", weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(plain, run, "page_id long, url string, text string, n_chars long")
