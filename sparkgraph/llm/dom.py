"""A tolerant reader of HTML: elements that may hold blocks, and the text blocks in them.

Start tags close what HTML lets them close (paragraphs, list items, cells); an
end tag closes up to the element it names, and one of a block that is not open
only ends the text before it. Text, or a start tag other than head content,
ends an open head. Unfinished comments and tags hold no text.
"""

from __future__ import annotations

import html
import re

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template svg math iframe object audio video canvas textarea select option datalist".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: Start tags that leave an open head open.
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Raw elements that hide nothing when no end tag follows.
OPEN = frozenset("noscript svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: Open elements that a start tag ends: a paragraph by any block, list items and cells by their like.
P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr body".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select",)}

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>|<[/a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    """An element other than inline formatting, with what it holds itself."""

    __slots__ = ("tag", "parent", "children", "names", "label", "depth", "n_tags", "blocks")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.names: tuple[str, ...] = ()
        self.label = None
        self.n_tags = 1
        self.blocks: list[Block] = []
        if parent:
            parent.children.append(self)
        if attributes and "=" in attributes:
            names: list[str] = []
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                value = a or b or c
                if key == "data-y":
                    self.label = value
                else:
                    names += (t.lower() for t in _TOKEN.findall(value))
            self.names = tuple(names)


class Block:
    """A run of text without a block boundary in it; ``linked`` characters of it stand in links."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def read(page: str) -> tuple[list[Node], list[Block]]:
    """All nodes in page order, the root first, and all blocks of text that a browser would show."""
    root = Node("body", None, "")
    nodes, blocks = [root], []
    node = root
    parts: list[str] = []
    link_parts: list[str] = []
    links = 0
    hidden: list[str] = []
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal parts, link_parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                block = Block(node, text, len(" ".join("".join(link_parts).split())))
                blocks.append(block)
                node.blocks.append(block)
            parts, link_parts = [], []

    def say(raw: str) -> None:
        if hidden == ["head"] and raw.strip():
            hidden.clear()
        if hidden or not raw:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        parts.append(raw)
        if links:
            link_parts.append(raw)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        closing = m[1]
        if closing:
            tag = closing.lower()
            if hidden:
                if tag in hidden:
                    while hidden.pop() != tag:
                        pass
            elif tag == "a":
                links = max(0, links - 1)
            elif tag in INLINE:
                pass
            elif tag in ("body", "html"):
                flush()
            else:
                up = node
                while up is not None and up.tag != tag:
                    up = up.parent
                if up is not None and up is not root:
                    flush()
                    node, links = up.parent, 0
                elif tag in P_ENDERS:
                    flush()
            continue
        opened = m[2] or m[4]
        if not opened:
            continue
        tag, attributes = opened.lower(), m[3] or m[5] or ""
        if hidden == ["head"] and tag not in HEAD:
            hidden.clear()
        if tag in RAW:
            if not attributes.endswith("/") and tag not in unclosed:
                close = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
                if close or tag not in OPEN:
                    at = close.end() if close else end
                else:
                    unclosed.add(tag)
            if not hidden and tag not in ("title", "script", "style"):
                parts.append(" ")
            continue
        if hidden:
            if tag in HIDDEN:
                hidden.append(tag)
            elif tag == "body" and "head" in hidden:
                hidden.clear()
            continue
        if tag in HIDDEN:
            hidden.append(tag)
            continue
        node.n_tags += 1
        if tag == "a":
            links += 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            continue
        if tag in ("html", "body"):
            if tag == "body" and attributes:
                root.names = Node("body", None, attributes).names
            continue
        flush()
        links = 0
        if tag in P_ENDERS:
            up = node
            while up is not root and up.tag not in ("p", "td", "th", "li", "div", "article", "section", "form", "button", "table"):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in ENDS:
            up = node
            while up is not root and up.tag not in ENDS[tag] and up.tag not in SCOPES[tag]:
                up = up.parent
            if up.tag in ENDS[tag]:
                node = up.parent
                if tag == "tr" and node.tag == "tr":
                    node = node.parent
        if tag in VOID:
            continue
        child = Node(tag, node, attributes)
        nodes.append(child)
        if not attributes.endswith("/"):
            node = child
    flush()
    return nodes, blocks
