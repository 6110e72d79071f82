"""Main text of web pages by tag-path ratios.

A page is cut into text nodes. Each node has a tag path (its chain of block-level elements
with their classes). Per path the text length and the number of punctuation marks per node are
taken, both ratios are smoothed along the nodes of the page, fused by their product, and the
nodes at or above the threshold (the mean of the fused scores times ``factor``) mark content.
Elements whose tag, role, class or id names page furniture (menus, notices, adverts, forms,
reader comments and the like) never enter. Inside an article a name counts only as a whole: ``related`` or
``related-posts`` is furniture, ``related-work`` a section; a header, a formula and a label are text there, and an
element of an ambiguous name (legal, form, notice and the like) stays if it holds marked text.

The article is the whole ``article`` element (every outermost one that holds marked text), else the whole ``main``
element, else the smallest element that holds all marked text; all its remaining blocks are the result, so
headings and one-word paragraphs stay. If only the page body itself holds all of it, the marked
paths and the headings are the result. Work is linear in the length of a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<]*+"|'[^'<]*+'|["'])*+)>|<[!?][^>]*+>""",
                    re.S)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_NAMES = (r"ads?|adverts?|advertisement|advertising|sidebar|menu|nav|navbar|navigation|"
          r"breadcrumbs?|footer|cookies?|gdpr|popup|modal|promo|"
          r"sponsor|sponsored|related|recommended|recommendations|sharing|social|subscribe|"
          r"newsletter|signup|comments?|commentlist|respond|disqus|login|pagination|pager|widgets?|toolbar|"
          r"complementary|contentinfo|alertdialog|dialog")
#: Inside an article these may name a part of the text: such an element stays if its tag paths mark any of it.
_DOUBTFUL_NAMES = (r"banner|consent|notice|overlay|promotion|share|subscription|search|legal|copyright|disclaimer|form|alert")
#: Inside an article a "header" or a "side" is part of the text.
_TEXT_NAMES = r"side|header|masthead"


#: What may follow or lead a furniture name in a compound one.
_PARTS = (r"box|bar|list|slot|container|block|wrap|wrapper|section|area|buttons?|links?|posts?|articles?|stories|unit|inner|panel|icons?|items?|"
          r"threads?|top|bottom|left|right|main|site|page|global|js|module|group|text|content|icon|title|heading|media|google|inline")


def _named(names: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{names})(?=$|[\s_-]|\d)", re.I)


def _wholly_named(names: str) -> re.Pattern:
    """A whole class name made of furniture names, with parts that only say what kind of box it is."""
    return re.compile(rf"(?:^|\s)(?:(?:{_PARTS})[_-]+)*(?:{names})\d*(?:[_-]+(?:{names}|{_PARTS}|\d+))*(?=$|\s)", re.I)


_FURNITURE = _named(f"{_NAMES}|{_DOUBTFUL_NAMES}|{_TEXT_NAMES}")
_CERTAIN, _DOUBTFUL = _wholly_named(_NAMES), _named(_DOUBTFUL_NAMES)
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
_DROPPED = {"nav", "footer", "aside", "form", "button", "select", "svg", "menu", "dialog", "head", "object", "canvas",
            "audio", "video", "fieldset", "input", "label", "math", "annotation", "annotation-xml"}
#: Of these and of header, what an article holds is its text.
_ARTICLE_TEXT = {"header", "object", "fieldset", "label", "math"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike "
              "strong sub sup time tt u var rp rt ruby img wbr br label "
              "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup "
              "msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr maction semantics "
              "annotation annotation-xml".split())
_CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                "h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
_BARRIER = {"ul", "ol", "dl", "table", "select", "td", "th", "article", "section", "div", "body", "main", "blockquote"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PUNCT = re.compile(r"[.,;:!?…。、，！？]")


class _Element:
    __slots__ = ("tag", "path", "up", "dropped", "mass", "in_article", "doubtful", "depth", "chosen")

    def __init__(self, tag: str, path: int, up: _Element | None, dropped: bool, in_article: bool):
        self.tag, self.path, self.up, self.dropped, self.in_article = tag, path, up, dropped, in_article
        self.depth = up.depth + 1 if up else 0
        self.mass = 0.0
        self.doubtful = self.chosen = False


def _is_furniture(tag: str, attrs: str, in_article: bool) -> tuple[bool, str]:
    names = " ".join(m[1].strip("\"'") for m in _ATTR.findall(attrs)) if attrs else ""
    if (tag in _DROPPED or tag == "header") and not (in_article and tag in _ARTICLE_TEXT):
        return True, names
    if tag in ("html", "body", "article", "main"):
        return False, names
    return bool(names and (_CERTAIN if in_article else _FURNITURE).search(names)), names


def text_blocks(html: str) -> tuple[list[_Element], list[tuple[_Element, str]]]:
    """All block-level elements of the page, parents first, and (element, text) of its blocks in order, furniture left out."""
    root = _Element("", 0, None, False, False)
    elements, blocks, parts = [root], [], []
    # Paths by number; open elements by tag; open inline elements and how many of them are dropped.
    paths: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = {}
    at, inline, hidden, pos = root, [], 0, 0

    def flush() -> None:
        if parts:
            if not at.dropped:
                text = _SPACE.sub(" ", "".join(parts)).strip()
                if text:
                    blocks.append((at, text))
            parts.clear()

    def text(upto: int) -> None:
        if upto > pos and not at.dropped and not hidden:
            parts.append(unescape(html[pos:upto]))

    def leave(upto: _Element) -> _Element:
        """Close the open elements from the current one up to and including ``upto``."""
        el = at
        while True:
            opened[el.tag] -= 1
            if el is upto:
                return el.up
            el = el.up

    while True:
        m = _TOKEN.search(html, pos)
        if m is None:
            text(len(html))
            break
        text(m.start())
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        # Outside an article a label or a formula is an element to drop, whatever it holds.
        flows = tag in _INLINE and (at.in_article or tag not in _ARTICLE_TEXT)
        if m[1]:
            if flows:
                if inline:
                    hidden -= inline.pop()
                continue
            if opened.get(tag):
                up = at
                while up.tag != tag:
                    up = up.up
                flush()
                at, inline, hidden = leave(up), [], 0
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        if tag == "br":
            if not at.dropped:
                parts.append(" ")
            continue
        if flows:
            if tag not in _VOID and not m[3].endswith("/"):
                inline.append(_is_furniture(tag, m[3], at.in_article)[0])
                hidden += inline[-1]
            continue
        flush()
        inline, hidden = [], 0
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            up = at
            while opened.get("p") and up is not root and up.tag not in _BARRIER and up.tag != "p":
                up = up.up
            if up.tag == "p":
                at = leave(up)
        elif tag in _SIBLINGS:
            up = at
            some = any(opened.get(t) for t in _SIBLINGS[tag])
            while some and up is not root and up.tag not in _SIBLINGS[tag] and up.tag not in _BARRIER - _SIBLINGS[tag]:
                up = up.up
            if up.tag in _SIBLINGS[tag]:
                at = leave(up)
                if tag == "tr" and at.tag == "tr":
                    at = leave(at)
        furniture, names = _is_furniture(tag, m[3], at.in_article)
        label = f"{tag}.{names}" if names else tag
        doubtful = at.in_article and bool(names and _DOUBTFUL.search(names))
        at = _Element(tag, paths.setdefault((at.path, label), len(paths) + 1), at, at.dropped or furniture, at.in_article or tag in ("article", "main"))
        at.doubtful = doubtful and tag not in ("article", "main")
        opened[tag] = opened.get(tag, 0) + 1
        elements.append(at)
    flush()
    return elements, blocks


def _smooth(values: list[float], radius: int = 1) -> list[float]:
    """Weighted mean of each value and its neighbours (weights halve with the distance)."""
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - radius), min(len(values), i + radius + 1)):
            w = 0.5 ** abs(i - j)
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def _choose(elements: list[_Element], total: float) -> None:
    """Mark the elements that make up the article; none if only the page itself holds all marked text."""
    for kind in ("article", "main"):
        found = [el for el in elements if el.tag == kind and el.mass and not el.dropped]
        # Parents come first: an element inside a chosen one belongs to it.
        inside: dict[int, bool] = {}
        for el in elements:
            inside[id(el)] = bool(el.up) and (inside[id(el.up)] or (el.up.tag == kind and el.up.mass > 0))
        if found:
            for el in found:
                el.chosen = not inside[id(el)]
            return
    holder = max((el for el in elements if el.mass >= total and el.tag not in ("p", *_HEADING)), key=lambda el: el.depth)
    holder.chosen = holder.tag not in ("", "html", "body")


def main_text(html: str, factor: float = 0.5) -> str:
    """The main text of one page; empty if it has none."""
    elements, blocks = text_blocks(html)
    if not blocks:
        return ""
    paths: dict[int, list[int]] = {}
    for el, text in blocks:
        p = paths.setdefault(el.path, [0, 0, 0])
        p[0] += len(text)
        p[1] += len(_PUNCT.findall(text))
        p[2] += 1
    ratio = _smooth([paths[el.path][0] / paths[el.path][2] for el, _ in blocks])
    punct = _smooth([(1 + paths[el.path][1]) / paths[el.path][2] for el, _ in blocks])
    fused = [r * p for r, p in zip(ratio, punct, strict=True)]
    cut = factor * sum(fused) / len(fused)
    best: dict[int, float] = {}
    for (el, _), f in zip(blocks, fused, strict=True):
        best[el.path] = max(best.get(el.path, 0.0), f)
    marked = {p for p, f in best.items() if f >= cut}
    total = 0
    for el, text in blocks:
        if el.path in marked:
            el.mass += len(text)
            total += len(text)
    for el in reversed(elements[1:]):
        el.up.mass += el.mass
    _choose(elements, total)
    some = any(el.chosen for el in elements)
    # Downwards: what lies in the article, and not in a part of ambiguous name without marked text.
    kept, left_out = set(), set()
    for el in elements:
        if el.chosen or (el.up and id(el.up) in kept):
            kept.add(id(el))
        if (el.doubtful and not el.mass) or (el.up and id(el.up) in left_out):
            left_out.add(id(el))
    # A headline of the main element that stands before its article.
    mains = {id(el) for el in elements if el.tag == "main" and el.mass}
    return "\n".join(text for el, text in blocks if id(el) not in left_out and (
        id(el) in kept if some and not (el.tag == "h1" and el.up and id(el.up) in mains) else some or el.path in marked or el.tag in _HEADING))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    One row per input row; a null or empty html gives an empty text; repeated rows stay; an empty
    table gives an empty result; other columns are ignored. Work per page is linear in its length."""

    @F.pandas_udf(StringType())
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(h or "") for h in batch], dtype="object")

    out = pages.select("page_id", "url", extracted(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
