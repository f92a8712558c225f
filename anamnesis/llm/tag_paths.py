"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of block elements from the root. Over the blocks of one
path the lengths and the punctuation marks are added up, and divided by their number. The ratios are
smoothed along the page, fused by their product, weighed by the elements of a path (names only tip the balance), and compared with a
threshold from their spread. The blocks above it are the text. The element that holds most of them, or the article or
main element around it, adds its other blocks, which are too short to pass by themselves, and so do headings beside them. Paths of menus, forms and
the like and paths made of links are left out, and so are those with a name that says notice, advert, comments or the like: inside of an article or main
element only where all words of the name say so. Names of the elements that hold most of a page's text don't count for that.

Paths are numbered as the page is read, so the work grows with its length, however deep its elements are nested.

Null and empty pages, and pages without a block above the threshold, have an empty text. Tags may be left open or be
closed twice. White space, character references included, becomes one space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from anamnesis.llm.common import send_code

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var".split()
)
BOILERPLATE = frozenset("nav header footer aside form menu button select dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
#: An open element that ends when one of the others begins beside it.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"},
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright "
    "discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pagination popup promo promoted recommended related replies responses share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags teaser toolbar widget alert reader".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
#: Words that say nothing by themselves beside one of BAD_NAMES.
PLAIN_NAMES = frozenset(
    "area article bar block bottom box container content div entry fixed footer group header inner item items left link links list main "
    "outer page panel post right row section site slot sticky text top unit user wrap wrapper".split()
)
#: Weight of an article or main element, of a name that says content, and of one that says boilerplate in part.
IN_CONTENT, GOOD_HINT, BAD_HINT = 10.0, 1.25, 0.5
PUNCTUATION = re.compile(r"[.,;:!?¡¿、。，！？]")

_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Paths:
    """Distinct paths of a page as a tree: 0 is the root, and a path has a greater number than its parent."""

    def __init__(self) -> None:
        self.parent, self.tag, self.names = [0], [""], [()]
        self._known: dict[tuple[int, str, tuple], int] = {}

    def below(self, parent: int, tag: str, names: tuple[tuple[str, ...], ...]) -> int:
        """``names`` has the words of each name that the element has."""
        found = self._known.setdefault((parent, tag, names), len(self.parent))
        if found == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
            self.names.append(names)
        return found

    def __len__(self) -> int:
        return len(self.parent)

    def labels(self, node: int) -> tuple[str, ...]:
        out = []
        while node:
            words = [w for name in self.names[node] for w in name]
            out.append(".".join([self.tag[node], *words]))
            node = self.parent[node]
        return tuple(reversed(out))

    def words(self, node: int) -> set[str]:
        return {w for name in self.names[node] for w in name}


@dataclass
class Block:
    paths: Paths
    node: int
    text: str
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        return self.paths.labels(self.node)


def _names(attributes: str) -> tuple[tuple[str, ...], ...]:
    """The words of every class, id and role."""
    if "=" not in attributes:
        return ()
    names = []
    for m in _NAMES.finditer(attributes):
        names += [tuple(_WORDS.findall(name)) for name in (m[2] or m[3] or m[4] or "").lower().split()]
    return tuple(name for name in names if name)


#: Elements that the search for an open element that ends has to look at.
_ENDING = frozenset(tag for tags in ENDS.values() for tag in tags)


def read_blocks(page: str) -> list[Block]:
    """Blocks of text in page order; text of scripts, styles and the head is left out."""
    paths = Paths()
    blocks: list[Block] = []
    # Open elements: tag, path, and the nearest one from it on that ends by itself or bounds the search for such.
    stack: list[tuple[str, int, int]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(paths, stack[-1][1] if stack else 0, text, linked))
        parts, linked = [], 0

    def leave(tag: str):
        nonlocal in_link
        flush()
        while True:
            name = stack.pop()[0]
            opened[name] -= 1
            if name == tag:
                break
        in_link = 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in RAW:
            if not closing:
                stop = re.compile(rf"</{re.escape(tag)}\s*>|<body\b" if tag == "head" else rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                parts.append(" ")
                at = size if not stop else stop.start() if stop[0][1] != "/" else stop.end()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in VOID:
            parts.append(" ")
            continue
        if closing:
            if opened[tag]:
                leave(tag)
            else:
                flush()
            continue
        if stack and stack[-1][0] == "p":
            leave("p")
        if tag in _ENDING:
            k = stack[-1][2] if stack else -1
            while k >= 0:
                name = stack[k][0]
                if tag in ENDS.get(name, ()):
                    leave(name)
                    break
                if name in SCOPES:
                    break
                k = stack[k - 1][2] if k else -1
        flush()
        near = len(stack) if tag in ENDS or tag in SCOPES else stack[-1][2] if stack else -1
        stack.append((tag, paths.below(stack[-1][1] if stack else 0, tag, _names(m[3] or m[6] or "")), near))
        opened[tag] += 1
    if at < size:
        parts.append(page[at:])
    flush()
    return blocks


def _held(blocks: list[Block], paths: Paths, chosen: Iterable[int] | None = None) -> list[int]:
    """Characters of text (of the chosen blocks) under each path."""
    held = [0] * len(paths)
    for b in blocks if chosen is None else (blocks[k] for k in chosen):
        held[b.node] += len(b.text)
    for node in range(len(paths) - 1, 0, -1):
        held[paths.parent[node]] += held[node]
    return held


def _weights(blocks: list[Block], paths: Paths) -> list[float]:
    """Of each path: 0 for boilerplate, else how much its ratio counts.

    Names don't make boilerplate of html, body, main and the outer article, nor of an element that holds three quarters of the text.
    """
    held = _held(blocks, paths)
    out, articles, content = [1.0] * len(paths), [0] * len(paths), [False] * len(paths)
    hints = [1.0] * len(paths)
    for node in range(1, len(paths)):
        up, tag, words = paths.parent[node], paths.tag[node], paths.words(node)
        articles[node] = articles[up] + (tag == "article")
        content[node] = content[up] or tag in CONTENT
        whole = tag in ("html", "body", "main") or (tag == "article" and articles[node] == 1) or held[node] >= 0.75 * held[0]
        bad = bool(words & BAD_NAMES) and not whole
        if bad and content[up]:
            bad = any(set(name) & BAD_NAMES and set(name) <= BAD_NAMES | PLAIN_NAMES for name in paths.names[node])
            hints[node] = hints[up] if bad else min(hints[up], BAD_HINT)
        else:
            hints[node] = max(hints[up], GOOD_HINT) if words & GOOD_NAMES and hints[up] >= 1 else hints[up]
        if out[up] == 0 or tag in BOILERPLATE or bad:
            out[node] = 0.0
        else:
            out[node] = (IN_CONTENT if content[node] else 1.0) * hints[node]
    return out


def path_ratios(blocks: list[Block]) -> np.ndarray:
    """Fused and smoothed ratio of each block."""
    totals: dict[int, list[float]] = {}
    for b in blocks:
        own = totals.setdefault(b.node, [0.0, 0.0, 0.0])
        own[0] += len(b.text) - 0.9 * min(b.linked, len(b.text))
        own[1] += len(PUNCTUATION.findall(b.text))
        own[2] += 1
    text = np.array([totals[b.node][0] / totals[b.node][2] for b in blocks])
    marks = np.array([totals[b.node][1] / totals[b.node][2] for b in blocks])
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel, mode="valid")
    weights = _weights(blocks, blocks[0].paths)
    return smooth(text) * (0.5 + smooth(marks)) * np.array([weights[b.node] for b in blocks])


def _inner(blocks: list[Block], paths: Paths, chosen: list[int]) -> int:
    """The deepest element under which most of the chosen text lies, or the article or main element around it."""
    held = _held(blocks, paths, chosen)
    depth = [0] * len(paths)
    for node in range(1, len(paths)):
        depth[node] = depth[paths.parent[node]] + 1
    inner = max((n for n in range(len(paths)) if held[n] >= 0.75 * held[0]), key=lambda n: (depth[n], -n))
    while inner and paths.tag[inner] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "ul", "ol", "td", "tr"):
        inner = paths.parent[inner]
    around = inner
    while around and paths.tag[around] not in CONTENT:
        around = paths.parent[around]
    return around or inner


def main_text(page: str | None) -> str:
    """The main text of a page."""
    blocks = read_blocks(page) if page else []
    if not blocks:
        return ""
    ratios = path_ratios(blocks)
    if not ratios.max() > 0:
        return ""
    paths = blocks[0].paths
    passed = set(np.flatnonzero((ratios >= min(ratios.std(), ratios.max())) & (ratios > 0)).tolist())
    inner = _inner(blocks, paths, sorted(passed))
    inside = [False] * len(paths)
    for node in range(len(paths)):
        inside[node] = node == inner or (node > 0 and inside[paths.parent[node]])
    links: dict[int, list[int]] = {}
    for b in blocks:
        own = links.setdefault(b.node, [0, 0])
        own[0] += b.linked
        own[1] += len(b.text)
    beside = {paths.parent[blocks[k].node] for k in passed}
    weights = _weights(blocks, paths)
    out = []
    for k, b in enumerate(blocks):
        title = b.node and paths.tag[b.node] in HEADINGS and paths.parent[b.node] in beside
        if weights[b.node] and (k in passed or title or inside[b.node]):
            linked, size = links[b.node]
            if 2 * linked <= size:
                out.append(b.text)
    return " ".join(out)


def extract(pages: DataFrame, html_col: str = "html", id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``id_cols`` and the main ``text`` of every row."""
    send_code(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*id_cols, "text"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    return pages.select(html_col, *id_cols).mapInArrow(run, f"{kinds}, text string")
