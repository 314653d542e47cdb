"""Normalisers, identifiers and predicates as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"
#: White space and punctuation, as a pattern's class.
GAP = r"\s,.;:!?()\[\]{}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(c: Column | str) -> Column:
    """Runs of Unicode white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)[\s&&[^ ]]\s*| \s+", " "))


def editorial_normalize(c: Column | str) -> Column:
    """Lower case, quotes dropped, punctuation as blanks, white space normalised."""
    bare = F.regexp_replace(F.lower(col(c)), "[\"'`“”‘’]", "")
    return F.trim(F.regexp_replace(bare, rf"(?U)[{GAP}&&[^ ]][{GAP}]*| [{GAP}]+", " "))


def strip_heading_number(c: Column | str) -> Column:
    bare = F.regexp_replace(col(c), r"(?U)^(?:§\s*)?\d+(?:\.\d+)*\.?\s+", "")
    return F.trim(F.regexp_replace(bare, r"(?iU)^section\s+\d+(?:\.\d+)*\.?\s+", ""))


def section_core(path: Column | str) -> Column:
    """The path's titles without numbers, in lower case."""
    parts = F.transform(F.split(col(path), ">"), lambda p: F.lower(strip_heading_number(F.trim(p))))
    return F.array_join(F.filter(parts, lambda p: p != ""), " > ")


def digest(*parts: Column | str, length: int = 64, separator: str = UNIT) -> Column:
    """SHA-256 of the parts (null as empty) with separators between, cut to `length` hex digits."""
    whole = F.sha2(F.concat_ws(separator, *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256)
    return whole if length == 64 else F.substring(whole, 1, length)


def requirement_id(document_sha256, locator, modality, start, text) -> Column:
    return digest(document_sha256, locator, modality, start, text, length=16)


def fingerprint(text, modality, actor, action, condition, exception) -> Column:
    """SHA-256 of the compact JSON object of the six fields, keys sorted, null as empty."""
    named = {"action": action, "actor": actor, "condition": condition, "exception": exception, "modality": modality, "normalized_text": text}
    return F.sha2(F.to_json(F.struct(*[F.coalesce(col(v), F.lit("")).alias(k) for k, v in named.items()])), 256)


def evidence_hash(kind: str, value: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(kind + UNIT), col(value)), 256)


def hash_set(*hashes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hashes))))


def change_id(classification, old_id, new_id, old_text, new_text) -> Column:
    return digest(classification, old_id, new_id, old_text, new_text, length=16)


def short_id(*parts, length: int = 16) -> Column:
    return digest(*parts, length=length)


def lineage_id(*parts) -> Column:
    return F.concat(F.lit("L-"), digest(*parts, length=12, separator="|"))


def modality_transition(old: Column | str, new: Column | str) -> Column:
    old, new = col(old), col(new)
    return F.when(old.isNotNull() | new.isNotNull(), F.concat(F.coalesce(old, F.lit("∅")), F.lit("->"), F.coalesce(new, F.lit("∅"))))


def confidence(action: Column | str, condition: Column | str, exception: Column | str) -> Column:
    base = F.when(col(action).isNotNull(), F.lit(0.9)).otherwise(F.lit(0.75))
    more = F.when(col(condition).isNotNull() | col(exception).isNotNull(), F.lit(0.05)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), base + more), 4)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays' distinct tokens; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), " "), lambda t: t != "")


def exact_https_url(url: Column | str, hosts: list[str] | None = None, path_pattern: str | None = None) -> Column:
    """An https URL of a plain host and path: no credentials, port, query, fragment or dot segments."""
    u = col(url)
    sound = u.rlike(r"^https://[a-z0-9.-]+(/[^?#\s]*)?$") & ~u.rlike(r"/\.{1,2}(/|$)") & ~u.rlike(r"%2[eEfF]")
    if hosts is not None:
        sound = sound & F.regexp_extract(u, r"^https://([^/]+)", 1).isin(hosts)
    if path_pattern is not None:
        sound = sound & F.regexp_extract(u, r"^https://[^/]+(/.*)?$", 1).rlike(path_pattern)
    return F.coalesce(sound, F.lit(False))


def portable_ref_problem(ref: Column | str) -> Column:
    """Why a reference is not a portable relative path; null if it is one."""
    r = col(ref)
    parts = F.split(r, "/")
    return (
        F.when(r.isNull() | (r == ""), "empty")
        .when(r.contains("\x00"), "control character")
        .when(r.contains("\\"), "backslash")
        .when(r.rlike(r"^[A-Za-z]:"), "drive letter")
        .when(r.startswith("/"), "absolute")
        .when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "URL")
        .when(F.exists(parts, lambda p: p == ""), "empty segment")
        .when(F.exists(parts, lambda p: (p == ".") | (p == "..")), "dot segment")
    )


def utc_second(c: Column | str) -> Column:
    """The timestamp of a YYYY-MM-DDTHH:MM:SSZ text, null unless it is exactly one."""
    text = col(c)
    when = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") & (F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'") == text), when)
