"""A small tolerant HTML parser: elements with their paths, and text by blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that run on inside a line of text; all others begin and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Starting one of these closes the open ones of the listed kinds.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
#: A list, table or box inside an item keeps that item open.
SCOPES = frozenset("ul ol dl table select div section article body html".split())

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


@dataclass(slots=True)
class Node:
    """An element: its tag, class and id words and other attributes, and children (elements or pieces of text)."""

    tag: str
    words: tuple[str, ...] = ()
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    @property
    def name(self) -> str:
        return ".".join((self.tag, *self.words)) if self.words else self.tag


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def parse(source: str) -> Node:
    """The tree under a nameless root; missing end tags are implied and stray ones ignored."""
    root = Node("")
    stack, at, lower = [root], 0, None
    for_text = lambda text: text and stack[-1].children.append(html.unescape(text))
    while True:
        m = _TAG.search(source, at)
        if m is None:
            for_text(source[at:])
            return root
        for_text(source[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag not in INLINE and tag != "br":  # a new block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                elif stack[k].tag in SCOPES:
                    break
        found = _attributes(m[3])
        words = tuple(sorted({w for key in ("class", "id") for w in re.sub(r"\d+", "0", found.get(key, "").lower()).split()}))
        node = Node(tag, words, found)
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in RAW and tag not in INLINE and tag in ("svg", "path"):
            continue
        if tag in RAW:
            if lower is None:
                lower = source.lower()
                lower = lower if len(lower) == len(source) else re.sub("[A-Z]+", lambda x: x[0].lower(), source)
            end = lower.find(f"</{tag}", at)
            end = len(source) if end < 0 else end
            node.children.append(source[at:end])
            close = source.find(">", end)
            at = len(source) if close < 0 else close + 1
            continue
        if len(stack) < 500:  # deeper elements stay as leaves of this depth
            stack.append(node)


def blocks(node: Node, skip) -> Iterator[tuple[Node, str]]:
    """``(block element, text)`` in page order, white space collapsed, without the elements for which ``skip`` holds."""
    pieces: list[str] = []

    def flush(owner: Node):
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            yield owner, text

    def walk(n: Node, owner: Node):
        for child in n.children:
            if isinstance(child, str):
                pieces.append(child)
            elif child.tag == "br" or child.tag == "hr":
                yield from flush(owner)
            elif skip(child):
                if child.tag not in INLINE:
                    yield from flush(owner)
            elif child.tag in INLINE:
                yield from walk(child, owner)
            else:
                yield from flush(owner)
                yield from walk(child, child)
                yield from flush(child)

    yield from walk(node, node)
    yield from flush(node)
