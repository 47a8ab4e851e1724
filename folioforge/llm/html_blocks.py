"""Blocks of an HTML page: runs of text between block-level tags, with the elements they stand in.

The reader takes pages as they are: unclosed paragraphs, list items and elements, closing tags without an opening one,
tags inside scripts and comments. It needs one pass and keeps a stack of open elements.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values, from the HTML standard: elements that begin a line of their own, and those whose text is no text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head template svg math object canvas audio video select datalist button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes if that is open in the same scope, and where the scope ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
}

#: A comment, a declaration, or a tag with its attributes; quoted values may hold ">".
_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAMED = re.compile(r"\b(?:class|id|role|style|hidden|aria-hidden)\b", re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    names: str = ""  #: class, id and role
    title: bool = False  #: holds a first-level heading or the main element
    hidden: bool = False
    size: int = 0  #: characters of text inside


@dataclass(slots=True)
class Block:
    text: str
    element: int  #: the innermost block-level element
    linked: int  #: characters inside links


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def read_page(source: str) -> Page:
    """The elements and non-empty text blocks of a page, in its order.

    Character references are decoded once, after tags are cut, so that escaped tags stay text. White space, <br> among
    it, becomes one space inside a block. Text of scripts, styles, the head, form controls and hidden elements is left out.
    """
    page = Page([Element("", -1)])
    elements, stack = page.elements, [0]  # numbers of open block-level and hidden elements
    parts: list[str] = []
    linked, links, hiding = 0, 0, 0
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                page.blocks.append(Block(text, stack[-1], min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal hiding
        while len(stack) > depth:
            hiding -= elements[stack.pop()].hidden

    def within(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> int:
        """Depth of the outermost of the open elements ``tags`` this side of ``stops``; 0 if none is open."""
        found = 0
        for depth in range(len(stack) - 1, 0, -1):
            tag = elements[stack[depth]].tag
            if tag in tags:
                found = depth
            elif tag in stops:
                break
        return found

    while at < end:
        found = _TAG.search(source, at)
        text = source[at : found.start() if found else end]
        if text and not hiding:
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue  # a comment or declaration
        if found[1]:  # closing
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or hiding:
                if not hiding:
                    flush()
                if depth := next((d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == tag), 0):
                    close(depth)
            continue
        if tag in RAW:
            closing = _END[tag].search(source, at)
            shut = source.find(">", closing.end()) if closing else -1
            at = end if shut < 0 else shut + 1
            continue
        if tag == "br":
            if not hiding:
                parts.append(" ")
            continue
        if tag in VOID and tag != "hr":
            continue
        raw = found[3] or ""
        if tag == "a":
            links = 1  # links do not nest
            continue
        names, hidden = "", tag in HIDDEN
        if raw and _NAMED.search(raw):
            values = _attributes(raw)
            names = " ".join(values.get(k, "") for k in ("class", "id", "role")).strip()
            hidden = hidden or "hidden" in values or values.get("aria-hidden") == "true" or bool(_UNSEEN.search(values.get("style", "")))
        if tag not in BLOCK and not hidden and not (hiding and tag in {elements[i].tag for i in stack}):
            continue  # inline
        if tag in BLOCK:
            if not hiding:
                flush()
            if depth := within({"p"}, _P_SCOPE) if tag not in ("option", "legend", "caption") else 0:
                close(depth)
            if tag in CLOSES and (depth := within(*CLOSES[tag])):
                close(depth)
        if tag == "hr" or raw.endswith("/") and tag in ("svg", "math", "object"):
            continue
        elements.append(Element(tag, stack[-1], names, tag in ("h1", "main"), hidden))
        stack.append(len(elements) - 1)
        hiding += hidden
    flush()
    _sum_up(page)
    return page


#: Elements in which an open paragraph outside is not closed by what begins inside.
_P_SCOPE = frozenset("table td th caption object template button".split())


def _sum_up(page: Page) -> None:
    """Sizes and titles of elements, from the blocks and elements inside; children follow their parents."""
    elements = page.elements
    for block in page.blocks:
        elements[block.element].size += len(block.text)
    for i in range(len(elements) - 1, 0, -1):
        above = elements[elements[i].parent]
        above.size += elements[i].size
        above.title = above.title or elements[i].title
