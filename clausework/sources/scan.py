"""Scans: raw documents with their sidecars, case files, header captures; gates and quarantine.

A document is read once (`binaryFile`), and everything downstream works on that row. What fails a
gate stays as a row with a reason, so nothing vanishes on the way.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.sources.markup import VOID, parse

# Elements whose end tag may be left out.
OPTIONAL_END = set("body colgroup dd dt head html li optgroup option p rb rp rt rtc tbody td tfoot th thead tr".split())
FAMILIES = ("generic_html", "rfc", "w3c", "whatwg")
# Header fields that may be kept.
HEADERS = ["content-length", "content-type", "date", "etag", "last-modified", "location"]
META_NAMES = ("version", "doc-version", "document-version", "spec-version")
RESERVED = ["canonical_source", "etag", "last_modified", "content_type", "document_family"]


class Balance(HTMLParser):
    """Finds the first reason why a page is not complete."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.problem: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
        names = [k for k, _ in attrs]
        if len(names) != len(set(names)):
            self.problem = self.problem or f"duplicate attribute in <{tag}>"

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        while self.open and self.open[-1] != tag and self.open[-1] in OPTIONAL_END:
            self.open.pop()
        if self.open and self.open[-1] == tag:
            self.open.pop()
        elif tag not in OPTIONAL_END:
            self.problem = self.problem or f"unexpected </{tag}>"


def html_problem(html: str | None) -> str | None:
    """Why markup is incomplete: an unbalanced element, an unfinished tag or comment; null if it is whole."""
    if not html or not html.strip():
        return "empty"
    if re.search(r"[\x00-\x08\x0b\x0e-\x1f]", html):
        return "control character"
    gate = Balance()
    gate.feed(html)
    if gate.rawdata.strip():
        return "unfinished markup at the end"
    gate.close()
    left = [t for t in gate.open if t not in OPTIONAL_END]
    return gate.problem or (f"<{left[-1]}> is never closed" if left else None)


def gate(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(html_problem)

    return run(html)


def quick_gate(html: Column) -> Column:
    """The coarse half of the gate as an expression: emptiness, control characters, unbalanced <b>, a missing end."""
    count = lambda p: F.regexp_count(html, F.lit(p))
    return (
        F.when(html.isNull() | (F.trim(html) == ""), "empty")
        .when(html.rlike(r"[\x00-\x08\x0b\x0e-\x1f]"), "control character")
        .when(count("(?i)<b>") != count("(?i)</b>"), "<b> unbalanced")
        .when(~F.lower(F.rtrim(html)).endswith("</html>"), "no end")
    )


def family_of(html: str | None) -> list[str]:
    """Every family whose structure a page shows."""
    if not html:
        return []
    tree = parse(html)
    text = lambda *tags: " ".join(" ".join(n.text().split()) for n in tree.find(*tags))
    links = [(set(n.attrs.get("rel", "").lower().split()), n.attrs.get("href", "")) for n in tree.find("link")]
    canonical = [h for rel, h in links if "canonical" in rel]
    with_class = lambda c: [n for n in tree.elements() if c in n.classes()]
    pre = tree.find("pre")
    found = []
    first = pre[0].text() if pre else ""
    spans = pre and any("h1" in n.classes() for n in pre[0].find("span"))
    if (html.lstrip().lower().startswith("<pre") and spans and re.search(r"(?:Request for Comments|RFC)\s*:?\s*\d+", first)) or (with_class("rfc") and re.search(r"\bRFC\s*\d+\b", text("title", "h1"), re.IGNORECASE)):
        found.append("rfc")
    head = " ".join(n.text() for n in with_class("head"))
    typed = any({"bibo:document"} & set(n.attrs.get("typeof", "").lower().split()) and "w3.org/2001/02pd/rec54" in n.attrs.get("prefix", "") for n in tree.find("html"))
    if typed or (any(re.fullmatch(r"https://www\.w3\.org/TR/[^?#\s]+", h) for h in canonical) and re.search(r"W3C\s+\w+", head)):
        found.append("w3c")
    sheets = any(re.fullmatch(r"https://resources\.whatwg\.org/[^?#\s]+", h) for rel, h in links if "stylesheet" in rel)
    logo = any(n.attrs.get("href") == "https://whatwg.org/" for n in tree.find("a") if "logo" in n.classes())
    header = text("header")
    standard = re.compile(r"\b(?:Living Standard|Standard|Review Draft)\b")
    if (sheets and logo and standard.search(text("title"))) or (any(re.fullmatch(r"https://[a-z]+\.spec\.whatwg\.org/[^?#\s]*", h) for h in canonical) and "whatwg" in header.lower() and standard.search(text("title") + " " + header)):
        found.append("whatwg")
    return found


def families(html: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(family_of)

    return run(html)


def family(html: Column) -> Column:
    """The one family shown, generic_html for none, null where several are shown (which is an error)."""
    all_ = families(html)
    return F.when(F.size(all_) == 1, all_[0]).when(F.size(all_) == 0, F.lit("generic_html"))


def version(html: Column, sha256: Column) -> Column:
    """Version of a page: meta, data attribute, RFC number in the title, number in the first heading, else the hash's start. Native."""
    hit = lambda pattern, group=1: F.nullif(F.trim(F.regexp_extract(html, pattern, group)), F.lit(""))
    metas = [hit(rf"(?is)<meta\s+name=[\"']{n}[\"']\s+content=[\"']([^\"']*)[\"']") for n in META_NAMES]
    datas = [hit(rf"(?is)\s{a}=[\"']([^\"']*)[\"']") for a in ("data-version", "data-spec-version")]
    title, h1 = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    bare = F.regexp_replace(h1, r"<[^>]*>", "")
    rfc = lambda c: F.nullif(F.regexp_extract(c, r"(?i)\bRFC\s*(\d+)\b", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(bare, r"(?i)\bv(?:ersion\s*)?(\d+(?:\.\d+)*)\b", 1), F.lit(""))
    return F.coalesce(*metas, *datas, F.concat(F.lit("RFC"), rfc(title)), number, F.concat(F.lit("RFC"), rfc(bare)), F.concat(F.lit("sha256:"), F.substring(sha256, 1, 12)))


def documents(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Raw documents under a folder: path, content, document_sha256, byte_length, and a reason to reject (null: sound). Files of no bytes never leave the scan."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(
        "path",
        "content",
        F.sha2("content", 256).alias("document_sha256"),
        F.length("content").cast("long").alias("byte_length"),
        F.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8").alias("rejected"),
    )


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Metadata files `NAME.meta.json` as maps, by the path that they belong to."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta.json").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.from_json(F.col("content").cast("string"), "map<string,string>").alias("meta"))


def with_provenance(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """Documents with what their sidecars say; the rest of a sidecar goes into fetch_metadata."""
    joined = docs.join(meta, "path", "left")
    known = [F.col("meta")[k].alias(k) for k in RESERVED]
    return joined.select(*docs.columns, *known, F.coalesce(F.map_filter("meta", lambda k, _: ~k.isin(RESERVED)), F.create_map().cast("map<string,string>")).alias("fetch_metadata"))


def sources(docs: DataFrame) -> DataFrame:
    """Sound documents with html, family and version; the gate's reason beside them."""
    html = F.col("content").cast("string")
    out = docs.where("rejected is null").withColumn("html", html)
    return out.select("path", "document_sha256", "byte_length", "html", family(F.col("html")).alias("document_family"), version(F.col("html"), F.col("document_sha256")).alias("document_version"), gate(F.col("html")).alias("quarantine"))


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Case rows of a JSON-lines file; blank lines and comments are left out, what does not parse is kept in _corrupt_record."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("c")).select("c.*")


def headers(captures: DataFrame, raw: str = "raw") -> DataFrame:
    """Allowed fields of HTTP header captures, one row each, in order: status lines and fields not allowed go."""
    rest = [c for c in captures.columns if c != raw]
    lines = captures.select(*rest, F.posexplode(F.split(F.col(raw), "\r\n")).alias("line", "text"))
    name = F.lower(F.trim(F.substring_index("text", ":", 1)))
    return lines.where(F.contains("text", F.lit(":")) & name.isin(HEADERS)).select(*rest, "line", name.alias("field"), F.trim(F.expr("substring(text, instr(text, ':') + 1)")).alias("value"))


def portable(refs: DataFrame, ref: str = "ref") -> DataFrame:
    return refs.withColumn("problem", T.portable_ref_problem(ref))
