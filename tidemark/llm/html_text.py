"""Main text of web pages by tag-path ratios.

Text blocks are grouped by their root-to-leaf tag path. Each path gets its text length and its punctuation a block; both
ratios are smoothed over the page's blocks and fused by their product, with the share of text outside links and the
evidence of names (an advert by name weighs little, text of an article by name more). Blocks whose fused ratio is above a
share of its spread are the content nodes. The deepest element that holds most of their text is the region of the article;
inside it, short blocks that belong to it (headings, captions, lists) are kept too, and content nodes outside it count by
their own path. Element kinds that are never article text (scripts, forms, menus and the like) are left out before that.

All steps take time in proportion to the page, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import batches, bounded_batches, extended

#: HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head nav footer aside script style noscript iframe object applet svg math button select textarea template dialog menu canvas audio video map".split())
RAW = frozenset("script style noscript iframe textarea title template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CONTAINERS = frozenset("table ul ol dl td th button article section div".split())
LEAVES = INLINE | frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd td th tr figcaption caption summary address blockquote".split())
CLOSED_BY = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Words of class, id and role values that are evidence of boilerplate, and words that say nothing beside them.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar header masthead footer colophon copyright legal social share sharing related recommended "
    "recommendations newsletter subscribe subscription signup login comment comments commentlist disqus respond replies widget widgets tags search form complementary contentinfo".split()
)
NEUTRAL = frozenset("site page main global top bottom left right area bar block body box buttons container content group inner items links list outer panel posts primary secondary section slot text unit wrap wrapper".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^a-zA-Z>]?[^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_WORDS = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·]")


#: Weight of a path that names say is boilerplate, and of one in an article.
UNLIKELY, LIKELY = 0.02, 2.0


class Element:
    """An element, and what follows from those around it. Numbers grow in page order, parents before children."""

    __slots__ = ("tag", "parent", "number", "path", "dropped", "marked", "named", "leaf", "block", "article")

    def __init__(self, tag: str, parent: Element | None, number: int, path: int, dropped: bool, marked: bool, named: bool):
        self.tag, self.parent, self.number, self.path, self.dropped = tag, parent, number, path, dropped
        self.named = named  # its own name says boilerplate
        self.marked = marked  # its name or one above does
        self.leaf = tag in LEAVES
        self.block = self if parent is None or tag not in INLINE else parent.block
        self.article = self if tag in ("article", "main") and (parent is None or parent.article is None) else parent and parent.article  # outermost


@dataclass(slots=True)
class Block:
    text: str
    at: Element
    linked: int


def _boilerplate(name: str) -> bool:
    """Whether a name has a mark, and beside marks only neutral words: `site-header` is one, `entry-header` is none."""
    found = _WORDS.findall(name)
    return any(w in MARKS for w in found) and all(w in MARKS or w in NEUTRAL for w in found)


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """The first class, and whether the element is named as boilerplate, and hidden."""
    label, marked, hidden = "", False, False
    for name, value in _NAMED.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class" and value.split():
            label = "." + value.split()[0]
        if name in ("class", "id", "role"):
            marked |= any(map(_boilerplate, value.split()))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return label, marked, hidden


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's non-empty text blocks in order, white space and character references resolved, boilerplate included; and
    all elements."""
    root = Element("", None, 0, 0, False, False, False)
    now, out, run, linked, links, at = root, [], [], 0, 0, 0
    elements, paths, opened = [root], {}, Counter()

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(Block(text, now.block, linked))
            run, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            run.append(text := html.unescape(text))
            if links:
                linked += len(text.strip())

    def close(until: Element) -> None:
        nonlocal now, links
        while now is not until:
            links -= now.tag == "a"
            opened[now.tag] -= 1
            now = now.parent

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            if tag not in INLINE:
                flush()
            if opened[tag]:
                node = now
                while node.tag != tag:
                    if tag in INLINE and node.tag not in INLINE:  # an inline end tag closes nothing outside its block
                        node = root
                        break
                    node = node.parent
                if node is not root:
                    close(node.parent)
            continue
        raw = m[3] if m[2] else m[6]
        if tag not in INLINE:
            flush()
        ends = ["p"] * (tag in CLOSES_P) + CLOSED_BY.get(tag, "").split()
        if any(opened[e] for e in ends):
            node, last = now, None
            while node is not root and node.tag not in CONTAINERS or node.tag in ends:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last:
                close(last.parent)
        if tag == "br":
            run.append(" ")
        if tag in VOID or raw.endswith("/") and tag in ("svg", "path"):
            continue
        label, named, hidden = _attributes(raw) if raw else ("", False, False)
        page_wide = tag in ("html", "body")
        named = (named or tag == "form") and not page_wide
        dropped = now.dropped or tag in DROPPED or hidden and not page_wide or tag == "header" and now.article is None
        now = Element(tag, now, len(elements), paths.setdefault((now.path, tag, label), len(paths) + 1), dropped, now.marked or named, named)
        elements.append(now)
        opened[tag] += 1
        links += tag == "a"
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            at = end.start() if end else len(page)
    flush()
    return out, elements


def _smoothed(values: np.ndarray, radius: int = 1) -> np.ndarray:
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / 2.0)
    padded = np.pad(values, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def path_scores(found: list[Block], marked: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The fused ratio of each block: text length a block of its path by punctuation a block of its path, by the share of the
    path's text outside links and the evidence of names. Both ratios smoothed over the blocks, and as they are."""
    stats: dict[int, list[int]] = {}
    for b in found:
        s = stats.setdefault(b.at.path, [0, 0, 0, 0])
        s[0] += len(b.text) - b.linked
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
        s[3] += len(b.text)
    own = [stats[b.at.path] for b in found]
    lengths = np.array([s[0] / s[2] for s in own], float)
    marks = np.array([s[1] / s[2] for s in own], float) + 0.1
    evidence = np.array([s[0] / s[3] * (UNLIKELY if m else LIKELY if b.at.article else 1.0) for s, m, b in zip(own, marked, found)], float)
    return _smoothed(lengths) * _smoothed(marks) * evidence, lengths * marks * evidence


def _held(found: list[Block], weights: np.ndarray, elements: list[Element]) -> list[float]:
    """The weight of the blocks in each element, by its number."""
    out = np.bincount([b.at.number for b in found], weights, len(elements)).tolist()
    for e in reversed(elements):
        if out[e.number] and e.parent is not None:
            out[e.parent.number] += out[e.number]
    return out


def _seeds(found: list[Block], marked: list[bool], spread: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Text lengths of the blocks above the threshold, 0 for others; the unsmoothed ratios, and the threshold."""
    scores, own = path_scores(found, marked)
    cut = min(spread * scores.std(), scores.max())
    return np.array([len(b.text) - b.linked for b in found], float) * (scores >= cut), own, cut


def _marked(found: list[Block], elements: list[Element], spread: float) -> list[bool]:
    """Whether a block is in an element that names say is boilerplate. Elements of one path that hold most of the text of
    high ratio, names left aside, are none; unless an article beside them holds a tenth of it, or one around them a third."""
    if not any(b.at.marked for b in found):
        return [False] * len(found)
    weights, _, _ = _seeds(found, [False] * len(found), spread)
    held = _held(found, weights, elements)
    beside = _held(found, weights * [not b.at.marked and b.at.article is not None for b in found], elements)
    by_path: dict[int, list[Element]] = {}
    for e in elements:
        if e.named and held[e.number]:
            by_path.setdefault(e.path, []).append(e)
    spared = set()
    for path, own in by_path.items():
        around = sum(beside[a.number] for a in {e.article for e in own if e.article is not None})
        rest = beside[0] - around
        if 2 * sum(held[e.number] for e in own) > held[0] and 10 * rest + 3 * around < held[0]:
            spared.add(path)
    marked = [False] * len(elements)
    for e in elements[1:]:
        marked[e.number] = marked[e.parent.number] or e.named and e.path not in spared
    return [marked[b.at.number] for b in found]


def main_text(page: str | None, spread: float = 0.5, most: float = 0.8) -> str:
    """The article of a page: its blocks joined by one blank. Empty without text outside boilerplate."""
    every, elements = blocks(page) if page else ([], [])
    found = [b for b in every if not b.at.dropped]
    if not found:
        return ""
    marked = _marked(found, elements, spread)
    weights, own, cut = _seeds(found, marked, spread)
    held = _held(found, weights, elements)
    core = max((e for e in elements if held[e.number] >= most * held[0] and not e.leaf), key=lambda e: e.number)
    core = core.article or core
    inside, articles = [False] * len(elements), False
    for e in elements:
        inside[e.number] = e is core or e.parent is not None and inside[e.parent.number]
        articles |= inside[e.number] and e.article is e and held[e.number] > 0

    def taken(b: Block, likely: bool, seed: bool, ratio: float) -> bool:
        if likely and inside[b.at.number] and (b.at.article is not None and held[b.at.article.number] > 0 or not articles):
            return seed or b.at.article is not None or b.linked < 0.6 * len(b.text)
        return ratio >= cut and b.linked < 0.6 * len(b.text)

    return " ".join(b.text for b, m, w, r in zip(found, marked, weights, own) if taken(b, not m, w > 0, r))


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, text and n_chars (its code points) of every page. A null or empty page has an empty text.

    Pages stay where they are: no shuffle.
    """
    bounded_batches(df.sparkSession)
    schema = extended(df.select(*keep).schema, "text string, n_chars bigint")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches(frames):
            texts = [main_text(p) for p in x.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return df.select(*keep, page).mapInArrow(run, schema)
