"""Family adapters: page furniture goes, RFC sources become plain HTML, then blocks as for any page."""

from __future__ import annotations

import html as escaping
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.sources.markup import BLOCK, HEADINGS, Node, blocks, parse

# Furniture of every family, and of each.
FURNITURE_TAGS, FURNITURE_IDS, FURNITURE_CLASS_PARTS = {"script", "style", "noscript", "nav", "footer"}, {"toc", "table-of-contents", "contents"}, ("sidebar", "breadcrumbs")
BOILERPLATE = {"status of this memo", "copyright notice", "table of contents", "abstract", "authors' addresses", "status of this document", "document conventions"}


def is_furniture(node: Node, family: str) -> bool:
    name, classes, role, place = node.tag, node.attrs.get("class", ""), node.attrs.get("role", ""), node.attrs.get("id", "")
    if name in FURNITURE_TAGS or place in FURNITURE_IDS or "toc" in classes.split() or any(p in classes for p in FURNITURE_CLASS_PARTS):
        return True
    if family == "rfc":
        return "noprint" in classes
    if family == "w3c":
        return place == "toc-nav" or (name == "p" and role == "navigation") or "copyright" in classes
    if family == "whatwg":
        return name == "header" or "status" in classes.split()
    return False


def stripped(tree: Node, family: str) -> Node:
    """The tree without furniture, and without sections whose heading is boilerplate: up to the next heading of the same rank."""
    for node in list(tree.elements()):
        kept, skip = [], 0
        for child in node.children:
            if isinstance(child, Node):
                if child.tag in HEADINGS:
                    rank, title = int(child.tag[1]), " ".join(child.text().lower().split())
                    title = re.sub(r"^\d+(?:\.\d+)*\.?\s+", "", title)
                    if title in BOILERPLATE or title.startswith("status of this"):
                        skip = rank
                    elif skip and rank <= skip:
                        skip = 0
                if is_furniture(child, family):
                    continue
            if not skip:
                kept.append(child)
        node.children = kept
    return tree


def rfc_xml_to_html(xml: str) -> str:
    """Sections, paragraphs, lists, artwork and asides of RFC XML as HTML. Document types and entities are refused."""
    if re.search(r"<!DOCTYPE[^>]*\[|<!ENTITY", xml, re.IGNORECASE):
        raise ValueError("document type subset or entity")
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*>", "", xml))
    except ET.ParseError as e:
        raise ValueError(f"not well-formed: {e}") from e
    out: list[str] = []
    text = lambda e: escaping.escape(" ".join("".join(e.itertext()).split()))
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    anchor = lambda e: f' id="{escaping.escape(e.get("anchor"))}"' if e.get("anchor") else ""

    def walk(e: ET.Element, depth: int) -> None:
        for child in e:
            kind = name(child)
            if kind == "section":
                title = child.get("title") or next((text(c) for c in child if name(c) == "name"), "")
                rank = min(6, depth + 1)
                out.append(f"<section{anchor(child)}><h{rank}>{escaping.escape(title) if child.get('title') else title}</h{rank}>")
                walk(child, depth + 1)
                out.append("</section>")
            elif kind == "t":
                lists = [c for c in child if name(c) in ("list", "ul", "ol")]
                if lists:
                    lead = " ".join((child.text or "").split())
                    out.append(f"<p{anchor(child)}>{escaping.escape(lead)}</p>" if lead else "")
                    walk(child, depth)
                else:
                    out.append(f"<p{anchor(child)}>{text(child)}</p>")
            elif kind in ("list", "ul", "ol"):
                out.append("<ul>" + "".join(f"<li{anchor(c)}>{text(c)}</li>" for c in child) + "</ul>")
            elif kind in ("artwork", "sourcecode", "figure"):
                out.append(f"<pre>{escaping.escape(''.join(child.itertext()))}</pre>")
            elif kind == "aside":
                out.append('<div class="note">')
                walk(child, depth)
                out.append("</div>")
            elif kind in ("middle", "back", "abstract", "note"):
                walk(child, depth)

    walk(root, 1)
    title = next((text(e) for e in root.iter() if name(e) == "title"), "")
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1>{''.join(out)}</body></html>"


def rfc_pre_to_html(page: str) -> str:
    """A paginated RFC in one <pre>: page heads go, heading spans become headings, blank lines part paragraphs."""
    tree = parse(page)
    pre = tree.find("pre")
    out, text = [], []

    def flush() -> None:
        for part in re.split(r"\n[ \t]*\n+", "".join(text)):
            if part.strip():
                out.append(f"<p>{escaping.escape(' '.join(part.split()))}</p>")
        text.clear()

    def walk(node: Node) -> None:
        for child in node.children:
            if not isinstance(child, Node):
                text.append(child)
            elif "grey" in child.classes():
                continue
            elif child.tag == "span" and (ranks := [c for c in child.classes() if re.fullmatch(r"h[1-6]", c)]):
                flush()
                out.append(f"<{ranks[0]}>{escaping.escape(' '.join(child.text().split()))}</{ranks[0]}>")
            else:
                walk(child)

    for node in pre:
        walk(node)
        text.append("\n\n")
    flush()
    return f"<html><body>{''.join(out)}</body></html>"


def adapted(page: str | None, family: str | None) -> list[dict]:
    """Blocks of a document of a family; one that cannot be adapted has none."""
    if not page:
        return []
    if family == "rfc" and page.lstrip().startswith(("<?xml", "<rfc")):
        try:
            page = rfc_xml_to_html(page)
        except ValueError:
            return []
    elif family == "rfc" and page.lstrip().lower().startswith("<pre"):
        page = rfc_pre_to_html(page)
    return blocks(page, lambda tree: stripped(tree, family or "generic_html"))


def adapted_blocks(html: Column, family: Column) -> Column:
    @F.pandas_udf(f"array<{BLOCK}>")
    def run(pages: pd.Series, families: pd.Series) -> pd.Series:
        return pd.Series([adapted(p, f) for p, f in zip(pages, families, strict=True)])

    return run(html, family)


def explode_adapted(sources: DataFrame) -> DataFrame:
    """Blocks of sources (html, document_family); the html is left behind."""
    rest = [c for c in sources.columns if c != "html"]
    return sources.select(*rest, F.inline(adapted_blocks(F.col("html"), F.col("document_family"))))
