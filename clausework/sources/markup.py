"""HTML to located text blocks.

The standard library's tokenizer feeds a small tree with implied end tags. A document becomes blocks
in reading order: text with its protected places, the path of headings above it, a locator, and
whether it lies in an informative region. One vectorised generator makes an array of blocks for
each document, so a corpus is one narrow stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element sets.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tfoot", "thead"}, "tbody": {"tbody", "tfoot", "thead"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
HEADINGS = {f"h{i}" for i in range(1, 7)}
IGNORED = set("script style noscript pre samp kbd textarea svg math".split())
CODE, QUOTE = {"code", "var"}, {"blockquote", "q"}
BLOCKS = {"p", "li", "dd", "td", "th", "div"}
DIV_CHILDREN = {"p", "li", "div", "ul", "ol", "table", "section"} | HEADINGS
INFORMATIVE = set("example note informative non-normative nonnormative illustration sample issue warning advisement annotation ednote editor-note impl implementation-note prac practice xxx todo".split())
INFORMATIVE_ROLES = {"note", "doc-example", "doc-note", "doc-tip"}
TRUE, FALSE = {"true", "1", "yes"}, {"false", "0", "no"}
# Section titles that are informative by themselves.
INFORMATIVE_TITLE = re.compile(r"(?:acknowledg|references|normative references|informative references|change log|changelog|revision history|table of contents|authors'? addresses)", re.IGNORECASE)
QUOTED = re.compile(r"\"[^\"]+\"|'[^']+'")

BLOCK = "struct<text: string, section_path: string, locator: string, structural_index: int, is_informative: boolean, xpath: string, spans: array<struct<s: int, e: int>>>"


class Node:
    """An element; children are nodes and strings in order."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self):
        """This node and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            top = stack.pop()
            if isinstance(top, str):
                out.append(top)
            else:
                stack += reversed(top.children)
        return "".join(out)

    def up(self):
        node = self
        while node is not None:
            yield node
            node = node.parent

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.elements() if n.tag in tags]

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").lower().split())


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("html", {}, None)

    def close_to(self, tags: set[str], scope: set[str]) -> None:
        for node in self.here.up():
            if node.tag in tags:
                self.here = node.parent or self.root
                return
            if node.tag in scope or node.parent is None:
                return

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html":
            self.root.attrs |= named
            return
        if tag in ("head", "body") and self.here.tag == "head":
            self.here = self.root
        if tag in CLOSES_P:
            self.close_to({"p"}, {"table", "td", "th", "button"})
        if tag in SIBLINGS:
            self.close_to(SIBLINGS[tag], SCOPES[tag])
        node = Node(tag, named, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.here.tag == tag and tag not in VOID and self.here.parent is not None and tag not in BLOCKS:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        for node in self.here.up():
            if node.tag == tag and node.parent is not None:
                self.here = node.parent
                return

    def handle_data(self, data):
        self.here.children.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def marker(node: Node) -> bool | None:
    """The nearest explicit word on whether a place is normative."""
    for n in node.up():
        said = n.attrs.get("data-normative", "").lower()
        if said in TRUE or said in FALSE:
            return said in TRUE
        classes = n.classes()
        if classes & {"non-normative", "nonnormative"}:
            return False
        if "normative" in classes:
            return True
        if classes & INFORMATIVE or n.attrs.get("role", "").lower() in INFORMATIVE_ROLES:
            return False
    return None


def xpath(node: Node, root: Node) -> str:
    steps = []
    for n in node.up():
        same = [c for c in n.parent.children if isinstance(c, Node) and c.tag == n.tag] if n.parent else [n]
        steps.append(n.tag if len(same) == 1 or n is root and n.parent is None else f"{n.tag}[{next(i for i, c in enumerate(same, 1) if c is n)}]")
        if n is root:
            break
    return "/" + "/".join(reversed(steps))


def block_text(element: Node) -> tuple[str, list[tuple[int, int]]]:
    """White-space normalised text without headings and ignored elements, and the places that code and quotes protect."""
    if element.tag in IGNORED:
        return "", []
    pieces: list[tuple[str, bool]] = []

    def collect(node: Node, guarded: bool, top: bool) -> None:
        inner = guarded or node.tag in CODE or node.tag in QUOTE
        tail = False  # text after a child is guarded as the element around it is, and not at all in the block itself
        for child in node.children:
            if isinstance(child, Node):
                if child.tag not in HEADINGS and child.tag not in IGNORED:
                    collect(child, inner, False)
                tail = True
            else:
                pieces.append((child, inner if not tail else guarded and not top))

    collect(element, False, True)
    chars, flags = [], []
    for text, guarded in pieces:
        for c in text:
            if not c.isspace():
                chars.append(c)
                flags.append(guarded)
            elif chars and chars[-1] != " ":
                chars.append(" ")
                flags.append(False)
    if chars and chars[-1] == " ":
        del chars[-1], flags[-1]
    text = "".join(chars)
    for m in QUOTED.finditer(text):
        flags[m.start() : m.end()] = [True] * (m.end() - m.start())
    spans, start = [], None
    for i, on in enumerate([*flags, False]):
        if on and start is None:
            start = i
        elif not on and start is not None:
            spans.append((start, i))
            start = None
    return text, spans


def blocks(html: str | bytes | None, prepare: Callable[[Node], Node] | None = None) -> list[dict]:
    """Blocks of a document; never fails on bad markup. prepare: what is done to the tree before."""
    if not html:
        return []
    tree = parse(html.decode("utf-8", "replace") if isinstance(html, bytes) else html)
    tree = prepare(tree) if prepare else tree
    body = tree.find("body")
    root = body[0] if body else tree
    path: list[tuple[int, str]] = []
    out = []
    for node in root.elements():
        if node.tag in HEADINGS:
            level = int(node.tag[1])
            path = [p for p in path if p[0] < level] + [(level, " ".join(node.text().split()))]
        elif node.tag in BLOCKS and not (node.tag == "div" and any(isinstance(c, Node) and c.tag in DIV_CHILDREN for c in node.children)):
            said = marker(node)
            quiet = said is not True and (said is False or any(n.tag in IGNORED or n.tag in QUOTE for n in node.up()) or bool(path and INFORMATIVE_TITLE.fullmatch(path[-1][1].strip())))
            text, spans = block_text(node)
            if len(text) < 3:
                continue
            place = xpath(node, root)
            name = node.attrs.get("id")
            out.append(
                dict(
                    text=text,
                    section_path=" > ".join(t for _, t in path) or "(root)",
                    locator=f"id:{name}|xpath:{place}" if name else f"xpath:{place}",
                    structural_index=len(out),
                    is_informative=quiet,
                    xpath=place,
                    spans=[{"s": s, "e": e} for s, e in spans],
                )
            )
    return out


def html_blocks(html: Column) -> Column:
    """Array of a document's blocks; html is a string or bytes in UTF-8."""

    @F.pandas_udf(f"array<{BLOCK}>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(blocks)

    return run(html)


def explode_blocks(documents: DataFrame, html: str = "html") -> DataFrame:
    """One row for each block of each document; the html itself is left behind."""
    rest = [c for c in documents.columns if c != html]
    return documents.select(*rest, F.inline(html_blocks(F.col(html))))
