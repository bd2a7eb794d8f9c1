"""Leaf text blocks of a web page with their tag paths."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements that end the text before and after them.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text. That of RAW is no markup either and goes on to the closing tag, or else to the page's end, as in
#: browsers; the others may hold elements of their own kind, and one that no tag closes hides nothing.
RAW = frozenset("iframe script style textarea title".split())
SILENT = RAW | frozenset("head noscript object svg template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these, if they are the innermost of their kind.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
_FENCE = frozenset("ul ol dl table select body article section nav main aside header footer".split())

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")


class Element:
    """An open element: its parent, its tag, and words of its class, id and role."""

    __slots__ = ("parent", "names", "memo")

    def __init__(self, parent: Element | None, names: tuple[str, ...]):
        self.parent, self.names, self.memo = parent, names, None

    @property
    def tag(self) -> str:
        return self.names[0]

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        """The names of each element from the outermost one to this one."""
        out, at = [], self
        while at is not None:
            out.append(at.names)
            at = at.parent
        return tuple(out[::-1])


@dataclass
class Leaf:
    text: str
    element: Element | None  # the innermost one around it
    linked: int  # characters within links

    @property
    def path(self) -> tuple[tuple[str, ...], ...]:
        return self.element.path if self.element else ()


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page in order; character references decoded, white space runs one space."""
    found: list[Leaf] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # open elements by tag
    never: set[str] = set()  # silent elements that no tag closes any more
    held: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            found.append(Leaf(text, stack[-1] if stack else None, min(linked, len(text))))
        held.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        held.append(text)
        if in_link:
            linked += len(text.strip())

    while (m := _MARKUP.search(page, at)) is not None:
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SILENT:
            if not closing and not rest.rstrip().endswith("/"):
                at = _behind(page, tag, at, never)
        elif tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in BLOCK:
            flush()
            in_link = False
            if closing:
                if opened[tag]:
                    _close(stack, opened, next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            else:
                _imply(stack, opened, tag)
                if tag not in VOID:
                    words = [tag]
                    for a, b, c in _NAMES.findall(rest) if "=" in rest else ():
                        words += _TOKEN.findall((a or b or c).lower())
                    stack.append(Element(stack[-1] if stack else None, tuple(words)))
                    opened[tag] += 1
        elif tag in VOID and tag not in ("wbr", "img"):
            held.append(" ")
    if at < len(page):
        say(page[at:])
    flush()
    return found


def _behind(page: str, tag: str, at: int, never: set[str]) -> int:
    """Where the content of a silent element that opens before `at` ends."""
    if tag in never:
        return at
    tags, depth, place = re.compile(rf"<(/?){tag}\b[^<>]*>", re.I), 1, at
    while depth:
        m = tags.search(page, place)
        if m is None:
            if tag in RAW:
                return len(page)
            never.add(tag)
            body = re.compile(r"(?=<body\b)", re.I).search(page, at) if tag == "head" else None
            return body.end() if body else at
        place = m.end()
        depth = 0 if m[1] and tag in RAW else depth - 1 if m[1] else depth + (tag not in RAW and not m[0].endswith("/>"))
    return place


def _close(stack: list[Element], opened: Counter[str], at: int) -> None:
    for e in stack[at:]:
        opened[e.tag] -= 1
    del stack[at:]


def _imply(stack: list[Element], opened: Counter[str], tag: str) -> None:
    """Close what an opening tag closes: an open paragraph, or an item of the same list or row."""
    for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
        if stack[i].tag == "p":
            _close(stack, opened, i)
            break
    closes = CLOSES.get(tag, ())
    if not any(opened[t] for t in closes):
        return
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag in closes:
            _close(stack, opened, i)
            if tag != "tr":
                return
        elif stack[i].tag in _FENCE:
            return
