"""HTML to text blocks, each with the zone of the page it stands in."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Zones.  What is unsure stands in an article or outside; its names speak both for and against an article, or against it only in part.
ARTICLE, OPEN, BOILERPLATE, UNSURE_ARTICLE, UNSURE = 0, 1, 2, 3, 4
#: An unsure block with so large a share of its characters in links is a list of links.
LINKED = 0.5
#: In an article, an element that a class speaks against in part goes if it has fewer characters: a bar of buttons, not a section.
SHORT = 24
#: An article with under this share of the largest one's characters is a card, and articles with under half of what stands outside are cards all.
FAR, CARDS = 0.2, 2.0

#: Element names by role.
RAW = frozenset("script style noscript template textarea title svg math iframe object select option button canvas audio video".split())
ASIDE = frozenset("nav aside footer form head dialog menu fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of class, id or role that mark what surrounds an article, those that mark what readers wrote, and those that name an article's own parts.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs cookie cookies consent disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget contentinfo complementary search alert".split()
)
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
CONTENT = frozenset("article body content entry post story text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACES = re.compile(r"\s+")


class _Names(NamedTuple):
    """What an element's names say: readers wrote it, it surrounds an article (a class or role says nothing else), it may, it is an article's part, its role is an article's."""

    readers: bool
    plain: bool
    partly: bool
    content: bool
    article: bool


_NONE = _Names(False, False, False, False, False)


def _names(attributes: str) -> _Names:
    if not attributes:
        return _NONE
    words: set[str] = set()
    plain = partly = article = False
    for m in _NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        for token in value.split():
            parts = [w for w in re.split(r"[^a-z0-9]+", token) if w]
            words.update(parts)
            marks = sum(w in MARKS for w in parts)
            partly = partly or marks > 0
            # An id may be no more than a heading's anchor, and one word of several may be the article's own.
            plain = plain or m[1].lower() != "id" and 0 < marks == len(parts)
        article = article or m[1].lower() == "role" and value.strip() in ("main", "article")
    return _Names(not READERS.isdisjoint(words), plain, partly, not CONTENT.isdisjoint(words), article)


def _class_marked(attributes: str) -> bool:
    """Whether a class or role, and not only an id, has a mark in it."""
    return any(m[1].lower() != "id" and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())) for m in _NAMED.finditer(attributes))


def main_blocks(found: list[tuple[str, int, int]], gone: set[int]) -> tuple[list[int], int]:
    """Places of the blocks that are a page's main text, and how many of its zone are left out as ``gone``.

    Outside an article, and where names leave it open, a block that is gone is
    no text.  The page's articles are its main zone, less those far smaller than
    the largest, unless what stands outside of them is over twice as long: then
    they are cards beside a text that names no article.
    """
    mass: dict[int, int] = {}
    for i, (line, zone, article) in enumerate(found):
        if zone != BOILERPLATE and (zone == ARTICLE or i not in gone):
            key = article if zone in (ARTICLE, UNSURE_ARTICLE) else 0
            mass[key] = mass.get(key, 0) + len(line)
    most = max((n for k, n in mass.items() if k), default=0)
    own = {k for k, n in mass.items() if k and n >= FAR * most}
    if not own or mass.get(0, 0) > CARDS * sum(mass[k] for k in own):
        zone_of = [i for i, (_, z, _) in enumerate(found) if z in (OPEN, UNSURE)]
    else:
        zone_of = [i for i, (_, z, a) in enumerate(found) if z in (ARTICLE, UNSURE_ARTICLE) and a in own]
    left = [i for i in zone_of if found[i][1] == ARTICLE or i not in gone]
    return left, len(zone_of) - len(left)


def blocks(html: str | None) -> list[tuple[str, int, int]]:
    """Blocks of text in page order with their zones and the number of the outermost article around them (0: none).

    White space inside a block is one space, and empty blocks are left out.

    Tags that are never closed end with the element around them, and a block
    element ends an open paragraph.  A null or empty page has no blocks.
    """
    if not html:
        return []
    out: list[tuple[str, int, int]] = []
    text: list[str] = []
    #: Name, zone and article outside of the element, and where its blocks begin if it has to be long to stay.
    stack: list[tuple[str, int, int, int | None]] = []
    zone, linked, in_link = OPEN, 0, False
    article = articles = 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            line = _SPACES.sub(" ", unescape(whole)).strip()
            if line:
                out.append((line, BOILERPLATE if zone >= UNSURE_ARTICLE and linked >= LINKED * len(whole) else zone, article))
            text.clear()
        linked = 0

    def judge(begin: int | None) -> None:
        if begin is not None and sum(len(x) for x, _, _ in out[begin:]) < SHORT:
            out[begin:] = [(x, BOILERPLATE, a) for x, _, a in out[begin:]]

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if not m:
            text.append(html[at:])
            break
        if m.start() > at:
            text.append(html[at : m.start()])
            linked += m.start() - at if in_link else 0
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if name == "a":
            in_link = not m[1]
        if m[1]:
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush() if stack[i][1:3] != (zone, article) else None
                    zone, article = stack[i][1:3]
                    judge(next((e[3] for e in stack[i:] if e[3] is not None), None))
                    del stack[i:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if not m[3].endswith("/"):
                at = end.end() if end else (n if name in ("script", "style") else at)
            if name not in INLINE:
                flush()
            continue
        if name == "br":
            text.append(" ")
        if name not in INLINE:
            flush()
        if name in VOID or m[3].endswith("/"):
            continue
        if name == "p":
            while stack and stack[-1][0] in INLINE:
                stack.pop()
            if stack and stack[-1][0] == "p":
                zone, article, begin = stack.pop()[1:]
                judge(begin)
        inner, whose = zone, article
        names = _names(m[3]) if name not in ("html", "body", "main") and name not in _HEADINGS else _NONE
        inside = zone in (ARTICLE, UNSURE_ARTICLE)
        if zone == BOILERPLATE or name in ASIDE or name == "header" and not inside or names.readers or names.plain and not names.content:
            inner = BOILERPLATE
        elif names.partly and not inside and name != "article":
            # Outside an article "site-footer" says enough, an id does not.
            inner = UNSURE if names.content or not _class_marked(m[3]) else BOILERPLATE
        elif names.partly and inside:
            inner = UNSURE_ARTICLE
        elif name in ("article", "main") or names.article:
            inner = zone if zone == UNSURE_ARTICLE else ARTICLE
            if not article:
                articles += 1
                whose = articles
        if (inner, whose) != (zone, article):
            flush()
        short = inner == UNSURE_ARTICLE and names.partly and not names.content and _class_marked(m[3])
        stack.append((name, zone, article, len(out) if short else None))
        zone, article = inner, whose
    flush()
    judge(next((e[3] for e in stack if e[3] is not None), None))
    return out
