"""Leaf blocks of a web page in order, with tag paths, and their feature vectors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: Attributes up to the tag's end. A quotation opens only where a value begins; one that never closes is plain text.
ATTRS = re.compile(r"((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"\w+")
#: Content that is no text, up to the end tag.
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag that ends an open element of these names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements beyond which an end tag, or one of ENDS, does not look.
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select", "datalist")}

#: Sizes of the parts of a feature vector: names on the path, the last two tags, words, shape of the text.
PATH, LAST, WORDS, SHAPE = 512, 64, 64, 10
#: Salts of the hashes under which common tags and names of classes fall on different places, as far as there are places.
ON_PATH, OF_TAG, OF_PARENT, OF_WORD = "n10153", "l15588", "u7448", "w"
SIZE = PATH + LAST + WORDS + SHAPE


class Element:
    """A place in the page's tree; siblings of one tag and names are one."""

    __slots__ = ("tag", "up", "names", "linked", "below")

    def __init__(self, tag: str = "", up: Element | None = None, names: frozenset[int] = frozenset(), linked: bool = False):
        self.tag, self.up, self.names, self.linked = tag, up, names, linked  # names: hashed, of the path down to here
        self.below: dict[tuple[str, frozenset[int]], Element] = {}

    def child(self, tag: str, own: frozenset[int]) -> Element:
        found = self.below.get((tag, own))
        if found is None:
            found = self.below[tag, own] = Element(tag, self, self.names if own <= self.names else self.names | own, self.linked or tag == "a")
        return found


class Block(NamedTuple):
    at: Element
    text: str
    linked: int  # characters in links


_slots: dict[str, int] = {}


def slot(kind: str, name: str, size: int) -> int:
    key = kind + name
    if (found := _slots.get(key)) is None:
        if len(_slots) > 200_000:
            _slots.clear()
        found = _slots[key] = crc32(key.encode()) % size
    return found


def names_of(attrs: str) -> list[str]:
    return [p.lower() for m in NAMED.finditer(attrs) for p in PART.findall(m[1] or m[2] or m[3] or "")]


class Tag(NamedTuple):
    start: int
    end: int
    name: str  # empty for comments, declarations and the like
    closing: bool
    attrs: str


def tags(page: str) -> Iterator[Tag]:
    """The tags; one with content that is no text ends behind its end tag. After a tag that the page's end cuts off each ends at the next >."""
    place, last, whole = 0, page.rfind(">"), True
    while (place := page.find("<", place)) >= 0:
        if page.startswith("<!--", place):
            end = page.find("-->", place + 2)
            end = len(page) if end < 0 else end + 3
            yield Tag(place, end, "", False, "")
        elif place > last:
            return
        elif m := NAME.match(page, place):
            rest = ATTRS.match(page, m.end()) if whole else None
            if rest:
                end, attrs = rest.end(), rest[1]
            else:  # the page ends within a quotation or an attribute
                whole, end = False, page.find(">", m.end()) + 1
                attrs = page[m.end() : end - 1]
            name = m[2].lower()
            if name in RAW and not m[1] and not attrs.endswith("/"):
                end = raw_end(page, name, end)
            yield Tag(place, end, name, bool(m[1]), attrs)
        elif page[place + 1 : place + 2] in ("!", "?", "/"):
            end = page.find(">", place) + 1
            yield Tag(place, end, "", False, "")
        else:
            end = place + 1
        place = end


def raw_end(page: str, tag: str, place: int) -> int:
    """Behind the end tag of content that is no text."""
    end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, place)
    return page.find(">", end.end()) + 1 or len(page) if end else len(page)


def blocks(page: str | None) -> list[Block]:
    """Blocks with any text, in page order. Block elements part blocks, inline elements and line breaks don't.

    Tags end as browsers end them: a quotation opens only where an attribute's value begins.
    """
    page = page or ""
    at, found, own, linked = Element(), [], [], 0
    open_tags: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        if own:
            text = " ".join(html.unescape("".join(own)).split())
            if text:
                found.append(Block(at, text, min(linked, len(text))))
            own.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            own.append(text)
            if at.linked:
                linked += len(text)

    def close(tags: tuple[str, ...], walls: tuple[str, ...] = ()) -> None:
        nonlocal at
        if not any(open_tags.get(t) for t in tags):
            return
        top = at
        while top.up is not None and top.tag not in tags:
            if top.tag in walls:
                return
            top = top.up
        if top.up is None:
            return
        while at is not top.up:
            open_tags[at.tag] -= 1
            at = at.up

    place = 0
    for m in tags(page):
        add(page[place : m.start])
        place, tag = m.end, m.name
        if not tag:
            continue
        if tag == "br":
            own.append(" ")
        elif m.closing:
            if tag not in INLINE:
                flush()
            close((tag,), () if tag not in INLINE else ("td", "th", "table"))
        else:
            if tag not in INLINE:
                flush()
            if tag in VOID or tag in RAW and not m.attrs.endswith("/"):
                continue
            if tag not in INLINE and open_tags.get("p"):
                close(("p",), ("td", "th", "table", "button", "object"))
            if tag in ENDS:
                close(ENDS[tag], WALLS[tag])
            at = at.child(tag, frozenset(slot(ON_PATH, x, PATH) for x in (tag, *names_of(m.attrs))))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    add(page[place:])
    flush()
    return found


def features(found: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """Vectors of the blocks from ``first`` to ``last`` of a page; all words of a block count."""
    some = found[first:last]
    out = np.zeros((len(some), SIZE), np.float32)
    for k, (at, text, linked) in enumerate(some):
        row, n = out[k], len(text)
        if at.names:
            row[list(at.names)] = 1
        own = at
        while own.tag in INLINE and own.up is not None:
            own = own.up
        row[PATH + slot(OF_TAG, own.tag, LAST // 2)] = 1
        row[PATH + LAST // 2 + slot(OF_PARENT, own.up.tag if own.up else "", LAST // 2)] = 1
        words = WORD.findall(text.lower())
        if words:
            places = [slot(OF_WORD, w, WORDS) for w in words]
            row[PATH + LAST : PATH + LAST + WORDS] = np.bincount(places, minlength=WORDS) / len(words)
        base = PATH + LAST + WORDS
        row[base : base + SHAPE] = (
            np.log1p(n) / 8, linked / n, len(words) > 10, len(words) > 30, text.count(",") / (len(words) + 1), text[-1] in ".!?…\"”»",
            sum(map(str.isdigit, text)) / n, (first + k) / len(found), own.tag in ("h1", "h2", "h3", "h4"), text[0].isupper(),
        )
    return out
