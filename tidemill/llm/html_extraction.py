"""Main text of web pages from flat text blocks and a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags.  Each block has its
word count and link density, those of the blocks before and after it, what kind of
element it is, whether it stands in an article or in an element for navigation and the
like, and one hint from class names.  A decision tree (Gini splits), trained when the
module is first used on the labelled blocks of ``LABELLED``, tells content from the rest:
where neither element nor class says anything, words and links of a block and its
neighbours decide.

Pages are read in one pass: each character is looked at a bounded number of times,
whatever is left open, quoted or nested.

Defined results: null, empty and unparsable pages have an empty text; markup that is
never closed ends with the page; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.textbatch import slices, texts_of

# Element names by kind.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label math mi mn mo mrow msup msub".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template textarea select option svg canvas iframe object head title button datalist video audio".split())
RAW = {"script", "style", "textarea", "title"}
BOILER_TAGS = set("nav footer aside form menu dialog fieldset".split())
MAIN_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = {"p", "li", "blockquote", "pre", "dd", "dt", "figcaption", "td"}
# Words of class, id and role.  Some mark a block as not content as a whole
# name only, the strong ones also as the last part of a hyphenated name.
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation topbar masthead header footer breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert alertdialog popup modal overlay "
    "newsletter subscribe signup login search share sharing social related recommended widget comment comments reply replies respond disqus pagination pager copyright toolbar contentinfo complementary form dialog banner skip-link site-header site-footer".split()
)
STRONG_NAMES = set("ad ads advert sidebar menu nav navbar navigation cookie cookies consent banner newsletter share sharing social related promo comments breadcrumb breadcrumbs pagination popup modal".split())
MAIN_NAMES = set("article main content post entry story text body-text article-body article-content article-header article-title post-content post-body post-header entry-content entry-title main-content page-content story-body".split())

# What holds no main text, whatever article or main element stands in it: elements,
# and parts of hyphenated names.
CLOSED_TAGS = set("nav aside footer menu dialog".split())
CLOSED_NAMES = set("comment comments commentlist replies respond disqus sidebar related recommended navigation".split())
LAYOUT_ENDS = set("layout page wrapper container grid open closed".split())  # comments-open, sidebar-layout: names of what is around

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>")
_ATTRS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_OPEN = re.compile(r"[a-zA-Z/!?]")

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "element", "zone", "hint")

#: Labelled blocks, as pages: +n stands for n words of content, -n for n other words.
LABELLED = """
<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></nav><div class=ad>-9</div><article><h1>+12</h1><p>+60<p>+3<p>+1<p>+120<p>+15</article><footer>-14</footer>
<nav><a>-1</a> <a>-1</a> <a>-1</a></nav><div class=ad>-16</div><article><h1>+4</h1><p>+2</p><p>+1</p></article><footer>-5</footer>
<div id=menu><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></div><div class=content><h1>+7</h1><p>+45 <a>+2</a><p>+30<p>+8<p>+52</div><div class=sidebar><h3>-2</h3><ul><li><a>-6</a><li><a>-7</a><li><a>-5</a></ul><p>-12</p></div><div class=footer>-11 <a>-2</a></div>
<h1>+5</h1><p>+4</p>
<h1>+9</h1><p>+25</p><p>+2</p><p>+33</p><p>+41</p>
<p>+14</p><p>+3</p><p>+16</p>
<p>+8</p><p>+7</p>
<header><a>-3</a><p>-4</p></header><nav><ul><li><a>-1</a><li><a>-1</a></ul></nav><main><h1>+8</h1><p>+5<p>+70<figure><figcaption>+12</figcaption></figure><ul><li>+10<li>+8<li>+14</ul><p>+55</main><aside><h2>-2</h2><ul><li><a>-8</a><li><a>-9</a></ul><p>-25</p></aside><footer><p>-9</p><ul><li><a>-2</a><li><a>-1</a></ul></footer>
<div class="cookie-banner"><p>-28</p></div><article><h1>+6</h1><p>+35<h2>+3</h2><p>+64</article><section class=comments><h3>-2</h3><div class=comment><p>-30</p></div><div class=comment><p>-12</p><p>-4</p></div></section>
<article><h1>+10</h1><p>+48<div class=share><a>-1</a> <a>-1</a></div><p>+66<div class="newsletter"><p>-18</p></div><p>+20<footer><a>-1</a> <a>-1</a> -3</footer></article><form><p>-7</p></form>
<div class="page has-sidebar"><div>-2 <a>-4</a></div><div><p>+90<p>+12<p>+44</div><div><a>-3</a> <a>-3</a> <a>-2</a></div></div><div>-6</div>
<table><tr><td><a>-1</a><br><a>-1</a><br><a>-2</a></td><td>+80<br>+35<br>+50</td></tr><tr><td>-4 <a>-2</a></td></tr></table>
<div class=article-header><h1>+8</h1></div><div class=article-body><p>+40</p><p>+18</p></div><div class=side-effects><p>+22</p></div><div class=related><h3>-2</h3><ul><li><a>-6</a><li><a>-8</a></ul></div>
<div>+70</div><div>-1 <a>-4</a></div><div>+85</div><div>-5</div>
<div><a>-1</a></div><div><a>-2</a></div><div><a>-1</a></div><div>+55</div><div>+48</div><div><a>-2</a> <a>-2</a></div>
<h2>+3</h2><p>+35 <a>+4</a> +12 <a>+6</a><ul><li>+6 <a>+2</a><li>+9 <a>+3</a></ul><h2>-2</h2><ul><li><a>-3</a><li><a>-2</a><li><a>-4</a></ul>
<div role=alert>-12</div><div class=content><p>+26</p><div class=ad>-8</div><p>+31</p></div><div role=contentinfo>-7</div>
<div class=post><h2>+6</h2><p>+28</p><blockquote>+17</blockquote><pre>+9</pre><p>+50</p></div><div class=pagination><a>-1</a> <a>-1</a></div><p class=copyright>-6</p>
<ul><li><a>-1</a><li><a>-1</a><li><a>-1</a></ul><h1>+6</h1><p>+30</p><p>+11</p><p>+27</p><ul><li><a>-2</a><li><a>-3</a></ul>
<main><div class="related-links"><a>-4</a></div><p>+9</p><p>+1</p></main>
<nav><a>-1</a></nav><article><h1><a>+6</a></h1><p><a>+3</a></p><p>+20</p><div>+7</div>+9</article><footer>-8</footer>
<article>+10<br>+4<br>+30<br>+1</article>
<article><h1>+6</h1><p>+30<p>+3</article><nav><a>-1</a></nav><div><a>-2</a></div>
<article><p>+20<p>+9</article><ul><li><a>-3</a><li><a>-2</a></ul>
<article><h1>+3</h1><ul><li><a>+3</a><li><a>+2</a></ul><p>+2</p><p><a>+4</a></p></article>
<p>+40</p><p>+5</p><div><a>-1</a> <a>-1</a></div>
<article><p>+30<p>+1</article><nav><a>-1</a></nav>
<article><p>+25 <a>+5</a><p>+18</article><nav><a>-1</a></nav>
<article><h1>+5<p>+60<p>+2</article><ul><li><a>-1</a><li><a>-1</a></ul>
<main><p>+12<p>+2<p>+1</main><nav><a>-4</a></nav>
<article><h1>+10<p>+80<p>+2<p>+120<p>+1<p>+90<p>+4<p>+200<p>+3<p>+60<p>+1<p>+5<p>+2</article><footer>-9</footer>
<article><h1>+1<p>+5<p>+300<p>+6<p>+75<p>+3<p>+10</article>
<h1>+6</h1><p>+80</p><p>+2</p><p>+120</p><p>+5</p><p>+1</p><p>+77</p><p>+4</p><div>-4</div>
<article><h1>+6</h1><p>+80<p>+60<p>+2<p>+95</article>
<p>+70<p>+90<p>+75
<div class=post><p>+100</p><p>+8</p></div>
<nav><a>-1</a> <a>-2</a></nav><p>+20</p>
<nav><a>-1</a> <a>-2</a></nav><main>+6</main>
<div><a>-1</a> <a>-1</a></div><div>+40<br>+90<br>+35</div>
<ul><li><a>-1</a><li><a>-3</a></ul><article><p>+5</p></article>
<main><div>+12</div><div>+3 <a>+1</a></div><div>+2</div></main>
<article><h1>+5</h1><p>+40<p>+22</article><div class=comments-area><ol><li class=comment><article class=comment-body><p>-35</p><p>-3</p></article><li class=comment><article class=comment-body><p>-80</p></article></ol></div>
<main><p>+18<p>+60</main><section class=comments><article><p>-45</p></article><article><p>-6</p></article></section><aside><article class=card><h3>-5</h3><p>-20</p></article><article class=card><p>-16</p></article></aside>
<article><table><tr><td>+4</td><td>+6</td></tr><tr><td>+3</td><td>+2</td></tr></table><p>+30</p></article><footer><article><p>-25</p></article></footer>
<article><header><h1>+7</h1><p>+4</p></header><div><div>+30</div><ul><li><a>+3</a><li><a>+5</a></ul></div></article>
"""


class Block:
    __slots__ = ("element", "hint", "linked", "text", "words", "zone")

    def __init__(self, text: str, linked: float, element: int, zone: int, hint: int):
        self.text, self.linked, self.element, self.zone, self.hint = text, linked, element, zone, hint
        self.words = text.count(" ") + 1


def _hint(names: str) -> int:
    """1 if class names speak for content, -1 if they speak against it, 0 if neither."""
    out = 0
    for name in names.lower().replace("_", "-").split():
        if name in MAIN_NAMES:
            return 1
        if name in BOILER_NAMES or (name.rsplit("-", 1)[-1] in STRONG_NAMES or name.split("-", 1)[0] in STRONG_NAMES) and not name.startswith(("has-", "with-", "no-")):
            out = -1
    return out


def _closed(tag: str, names: str, own: int) -> bool:
    """Whether an element shuts out main text: by its kind, or by a name if no other one speaks for content."""
    if tag in CLOSED_TAGS:
        return True
    parts = [n.split("-") for n in names.lower().replace("_", "-").split()]
    return own <= 0 and any({p[0], p[-1]} & CLOSED_NAMES and p[0] not in ("has", "with", "no") and p[-1] not in LAYOUT_ENDS for p in parts)


def blocks(page: str) -> list[Block]:
    """The flat list of text blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = link_depth = zone = hint = element = 0
    shut = False  # inside an element that holds no main text
    lower: str | None = None
    ends: dict[str, re.Pattern | None] = {}  # None: no further end tag of that name
    size, at = len(page), 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(1.0, linked / max(1, sum(map(len, parts)))), element, zone, hint))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link_depth:
                linked += len(text)

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            add(page[at:])
            break
        if mark > at:
            add(page[at:mark])
        at = mark
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else size
            continue
        m = _TAG.match(page, at)
        if not m:
            if not _OPEN.match(page, at + 1):  # a sign, no tag
                add("<")
                at += 1
                continue
            # A tag that a new one cuts off, or that never ends, is not text.
            nxt = page.find("<", at + 1)
            at = nxt if nxt >= 0 else size
            continue
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag == "a":
            link_depth = 0 if closing else 1
            continue
        if tag in INLINE and tag != "wbr":
            continue
        if tag in HIDDEN and not closing:
            if tag not in ends:
                ends[tag] = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE)
            end = ends[tag].search(page, at) if ends[tag] else None
            if end is None:
                ends[tag] = None
                if tag in RAW:
                    at = size
            else:
                at = end.end()
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if opened[tag]:
                while True:
                    name, *_ = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
            zone, hint, shut = stack[-1][1:] if stack else (0, 0, False)
            element = 0
            for name in stack[-1:]:
                element = 2 if name[0] in HEADINGS else 1 if name[0] in PARAGRAPHS else 0
            link_depth = 0
            continue
        names, hidden = "", False
        if m[3]:
            for a in _ATTRS.finditer(m[3]):
                name, v = a[1].lower(), (a[2] or a[3] or a[4] or "")
                if name in ("class", "id", "role"):
                    names += f" {v}"
                hidden |= name == "hidden" or name == "aria-hidden" and v == "true" or name == "style" and "display:none" in v.replace(" ", "").lower()
        if tag in ("p", *HEADINGS) and stack and stack[-1][0] == "p":  # a paragraph ends where the next one begins
            opened[stack.pop()[0]] -= 1
            zone, hint, shut = stack[-1][1:] if stack else (0, 0, False)
        own = _hint(names) if names and tag not in ("html", "body") else 0
        shut = shut or hidden or tag not in ("html", "body") and _closed(tag, names, own)
        if tag in MAIN_TAGS and not shut:
            zone, hint = 1, 0
        elif shut or tag in BOILER_TAGS or tag == "header" and zone < 1:
            zone = -1
        hint = -1 if shut else own or hint
        element = 2 if tag in HEADINGS else 1 if tag in PARAGRAPHS else 0
        stack.append((tag, zone, hint, shut))
        opened[tag] += 1
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0.0, *(b.linked for b in found), 0.0])
    flags = np.array([(b.element, b.zone, b.hint) for b in found], float).reshape(-1, 3)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags])


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``LABELLED``."""
    x, y = [], []
    for page in LABELLED.strip().split("\n"):
        found = blocks(re.sub(r"([+-])(\d+)", lambda m: " ".join([m[1] + "w"] * int(m[2])), page))
        x.append(features(found))
        y += [b.text.startswith("+") for b in found]
    return np.concatenate(x), np.array(y, float)


class Tree:
    """A classification tree with Gini splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, least: int = 1):
        self.share = float(y.mean()) if len(y) else 0.0
        self.split = None
        best = 1e-9
        impurity = lambda v: len(v) * 2 * v.mean() * (1 - v.mean())
        if len(y) >= 2 * least and 0 < self.share < 1:
            whole = impurity(y)
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] <= cut
                    if min(low.sum(), (~low).sum()) < least:
                        continue
                    gain = whole - impurity(y[low]) - impurity(y[~low])
                    if gain > best:
                        best, self.split = gain, (f, cut)
        if self.split:
            low = x[:, self.split[0]] <= self.split[1]
            self.low, self.high = Tree(x[low], y[low], least), Tree(x[~low], y[~low], least)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.split or not len(x):
            return np.full(len(x), self.share)
        low = x[:, self.split[0]] <= self.split[1]
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


@cache
def tree() -> Tree:
    return Tree(*labelled())


def main_texts(pages: list[str]) -> list[str]:
    """The content of each page; the blocks of all pages are classified together."""
    found = [blocks(p) for p in pages]
    every = [features(f) for f in found if f]
    keep = tree().predict(np.concatenate(every)) >= 0.5 if every else np.zeros(0, bool)
    out, at = [], 0
    for f in found:
        out.append(" ".join(b.text for b, k in zip(f, keep[at : at + len(f)].tolist(), strict=True) if k))
        at += len(f)
    return out


def main_text(page: str) -> str:
    return main_texts([page])[0]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            texts = main_texts(texts_of(part, "html"))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_run, f"page_id {kind}, url string, text string, n_chars long")
