from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from clausework.operators import suites
from clausework.sources import adapters, manifest

XML = """<rfc number="9999"><front><title>Sample</title></front><middle>
<section anchor="s1" title="Rules &amp; more"><t anchor="p1">Clients MUST retry.</t><t>Kinds:<list><t>one MAY go</t><t>two</t></list></t>
<artwork>Servers MUST explode</artwork><aside><t>Clients MUST dream.</t></aside></section></middle></rfc>"""


def test_rfc_xml():
    found = adapters.adapted(XML, "rfc")
    assert [b["text"] for b in found] == ["Clients MUST retry.", "Kinds:", "one MAY go", "two", "Clients MUST dream."]
    assert found[0]["section_path"] == "Sample > Rules & more" and found[0]["locator"].startswith("id:p1|")
    assert found[-1]["is_informative"]
    assert adapters.adapted('<?xml version="1.0"?><!DOCTYPE rfc [<!ENTITY a "b">]><rfc/>', "rfc") == []
    with pytest.raises(ValueError):
        adapters.rfc_xml_to_html("<rfc>")


def test_rfc_pre():
    page = '<pre>RFC 1\n\n<span class="h2">1. Intro</span>\n\nClients MUST\n  wait.\n\n<span class="grey">Page 2</span>\nNext one.</pre>'
    found = adapters.adapted(page, "rfc")
    assert [b["text"] for b in found] == ["RFC 1", "Clients MUST wait.", "Next one."]
    assert found[1]["section_path"] == "1. Intro"


def test_furniture():
    page = '<body><nav><p>menu here</p></nav><h2>Abstract</h2><p>short words</p><h2>1. Rules</h2><p>Clients MUST go.</p><p class="copyright">by us all</p><header><p>top of it</p></header></body>'
    texts = lambda f: [b["text"] for b in adapters.adapted(page, f)]
    assert texts("w3c") == ["Clients MUST go.", "top of it"]
    assert texts("whatwg") == ["Clients MUST go.", "by us all"]


def test_explode_adapted(spark):
    df = spark.createDataFrame([("a", XML, "rfc"), ("b", None, None)], "k string, html string, document_family string")
    assert adapters.explode_adapted(df).groupBy("k").count().collect()[0]["count"] == 5


def test_manifest(spark, tmp_path):
    sha = lambda c: c * 64
    record = lambda i, **more: dict(source_id=f"s{i}", document_family="rfc", standard_id=f"x{i}", version=f"{i}", canonical_url=f"https://a.org/{i}", output_ref=f"a/{i}.html", sha256=sha(str(i)), byte_length=5, retrieved_at="2024-01-01T00:00:00Z") | more
    good = [record(1), record(2)]
    path = tmp_path / "m.json"
    path.write_text(json.dumps(dict(schema_version="1", policy_sha256="p", sources=good), indent=1))
    assert manifest.problems(manifest.manifest(spark, str(path))).count() == 0
    bad = [record(1), record(1, output_ref="A/1.HTML", canonical_url="http://a.org", byte_length=0, retrieved_at="now"), record(3, document_family="w3c", sha256="q")]
    path.write_text(json.dumps(dict(sources=bad)))
    rows = {r["problem"] for r in manifest.problems(manifest.manifest(spark, str(path))).collect()}
    assert rows == {"repeated source_id", "repeated sha256", "repeated output_ref", "URL out of form", "size out of bounds", "time out of form", "hash out of form", "too little variety"}
    found = spark.createDataFrame([("a/1.html", sha("1"), 5), ("a/9.html", "z", 1)], "ref string, sha256 string, byte_length long")
    path.write_text(json.dumps(dict(sources=good)))
    assert {(r["ref"], r["problem"]) for r in manifest.replay(manifest.manifest(spark, str(path)), found).collect()} == {("a/2.html", "missing"), ("a/9.html", "unlisted")}


CASES = [
    ("01", "rfc2119", "Clients SHOULD retry failed requests.", "Clients MUST retry failed requests.", ["STRENGTHENED"]),
    ("02", "rfc2119", "Clients MUST retry failed requests.", "Clients MAY retry failed requests.", ["WEAKENED"]),
    ("03", "rfc2119", "Servers MUST log errors.", "Servers MUST NOT log errors.", ["POLARITY_FLIP"]),
    ("05", "rfc2119", "Servers MUST log errors, always.", "Servers MUST log errors always.", ["EDITORIAL"]),
    ("06", "rfc2119", "", "Servers MUST log errors.", ["ADDED"]),
    ("07", "rfc2119", "Servers MUST log errors.", "", ["REMOVED"]),
    ("08", "rfc2119", "Servers MUST cache keys.", "Servers MUST cache keys unless private mode is active.", ["EXCEPTION_ADDED"]),
    ("09", "rfc2119", "Servers MUST cache keys.", "Servers MUST cache keys when the store is open.", ["CONDITION_ADDED"]),
    ("10", "rfc2119", "The mustard must wait.", "The mustard should wait.", []),
    ("11", "whatwg", "The parser must stop.", "The parser must stop.", ["UNCHANGED"]),
]


def test_suite(spark):
    rows = [(i, p, f"<p>{a} text</p>" if not a else f"<p>{a}</p>", f"<p>{b}</p>", e, ["AMBIGUOUS"], [], False) for i, p, a, b, e in CASES]
    cases = spark.createDataFrame(rows, "id string, profile string, old string, new string, expected array<string>, forbidden array<string>, focus array<string>, allow_extra boolean")
    got = {r["id"]: r["passed"] for r in suites.run(cases).collect()}
    assert got == {c[0]: True for c in CASES}


def test_item_key_and_locators(spark):
    assert suites.item_key("t", "s", ["b", "a"]) == suites.item_key("t", "s", ["a", "b"]) != suites.item_key("t", "x", ["a", "b"])
    df = spark.createDataFrame([("id:a",), ("é",), ("a\u0007",), (" a",), (None,)], "l string")
    assert [r[0] for r in df.select(suites.locator_problem(F.col("l"))).collect()] == [None, "not NFC", "control character", "white space at its ends", "empty"]
