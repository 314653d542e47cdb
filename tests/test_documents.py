from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausework.operators import align, classify, definitions, lineage, scoring
from clausework.operators.extract import extract
from clausework.plans import diff
from clausework.sources import markup, scan

OLD = """<html><head><meta name="version" content="1.0"><title>Spec</title></head><body><h1>Spec</h1>
<h2>1. Transport</h2><p id="a">Clients MUST retry failed requests.</p><p id="b">Servers SHOULD log failures.</p>
<h2>2. Storage</h2><p id="c">Servers MUST NOT store credentials in plain text.</p><p id="d">Browsers MAY cache keys.</p>
<div class="example"><p>Clients MUST explode.</p></div><p>Use <code>MUST</code> sparingly.</p></body></html>"""
NEW = """<html><head><meta name="version" content="2.0"><title>Spec</title></head><body><h1>Spec</h1>
<h2>1. Transport</h2><p id="a">Clients SHOULD retry failed requests.</p><p id="b">Servers SHOULD NOT log failures.</p>
<h2>3. Vault</h2><p id="c">Servers MUST NOT store credentials in plain text.</p>
<h2>4. Cache</h2><p id="d">Browsers MAY cache keys unless private mode is active.</p><p id="e">Proxies MUST forward the original header untouched.</p></body></html>"""


def pages(spark, *htmls):
    rows = [(f"s{i}", str(i), h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "document_sha256 string, document_version string, html string")


def test_blocks():
    found = markup.blocks(OLD)
    assert [b["text"] for b in found][:2] == ["Clients MUST retry failed requests.", "Servers SHOULD log failures."]
    assert found[0]["section_path"] == "Spec > 1. Transport"
    assert found[0]["locator"].startswith("id:a|xpath:/")
    assert [b["is_informative"] for b in found] == [False, False, False, False, True, False]
    code = found[-1]
    assert [code["text"][s["s"] : s["e"]] for s in code["spans"]] == ["MUST"]
    assert markup.blocks("") == [] and markup.blocks(None) == []


def test_nested_and_unclosed():
    texts = [b["text"] for b in markup.blocks("<ul><li>one two<li><p>three four</ul><p>five six<p>seven <b>eight")]
    assert texts == ["one two", "three four", "three four", "five six", "seven eight"]


def test_extract(spark):
    rows = extract(pages(spark, OLD)).orderBy("structural_index").collect()
    assert [(r["modality"], r["actor"]) for r in rows] == [("MUST", "Clients"), ("SHOULD", "Servers"), ("MUST_NOT", "Servers"), ("MAY", "Browsers")]
    assert rows[0]["action"] == "retry failed requests" and rows[0]["confidence"] == 0.9
    assert len({r["requirement_id"] for r in rows}) == 4


def test_diff_classes(spark):
    reqs = extract(pages(spark, OLD, NEW)).withColumn("pair", F.lit(1))
    old, new = reqs.where("document_sha256 = 's0'"), reqs.where("document_sha256 = 's1'")
    rows = diff.diff(old, new, ["pair"]).collect()
    got = sorted(r["classification"] for r in rows)
    assert got == sorted(["WEAKENED", "POLARITY_FLIP", "MOVED", "EXCEPTION_ADDED", "ADDED"])
    again = diff.diff(old.repartition(3), new.repartition(2), ["pair"]).collect()
    assert sorted(r["change_id"] for r in rows) == sorted(r["change_id"] for r in again)


def test_greedy_leaves_close_rivals_alone():
    edge = lambda o, n, s: (o, o, 0, n, n, 0, s, s, s, False)
    assert align.greedy([edge("a", "x", 0.9), edge("a", "y", 0.88)]) == []
    assert [e[align.NEW] for e in align.greedy([edge("a", "x", 0.9), edge("a", "y", 0.7)])] == ["x"]
    assert align.greedy([edge("a", "x", 0.61)]) == []


def test_split_and_merge_links():
    edge = lambda o, n, s, i=0, j=0: (o, f"core {o}", i, n, f"core {n}", j, s, s, s, False)
    split = align.pair_links([edge("a", "x", 0.8), edge("a", "y", 0.79, 0, 1)])
    assert [(k[0], k[1], k[2]) for k in split if k[0] == "split"] == [("split", "a", "x"), ("split", "a", "y")]
    merge = align.pair_links([edge("a", "x", 0.8), edge("b", "x", 0.79, 1, 0)])
    assert [(k[1], k[2], k[-1]) for k in merge if k[0] == "merge"] == [("a", "x", True), ("b", "x", True)]


def test_lineage(spark):
    docs = pages(spark, OLD, NEW, NEW.replace("2.0", "3.0").replace("Proxies MUST forward", "Proxies SHOULD forward"))
    reqs = extract(docs)
    versions = spark.createDataFrame([("spec", i, f"s{i}", str(i)) for i in range(3)], "standard string, seq int, document_sha256 string, document_version string")
    edges, _, seeded = diff.chain(reqs, versions)
    rows = edges.collect()
    counts = {}
    for r in rows:
        counts[r["relation"]] = counts.get(r["relation"], 0) + 1
    assert counts == {"CONTINUES": 9, "ADDED": 1}
    placed = lineage.instances(edges, seeded, versions)
    assert lineage.violations(edges, placed).count() == 0
    assert lineage.input_violations(versions, reqs).count() == 0
    firsts = {r["first_version"]: r["n"] for r in lineage.nodes(placed, versions).groupBy("first_version").agg(F.count("*").alias("n")).collect()}
    assert firsts == {"0": 4, "1": 1}


def test_chain_with_definitions(spark):
    old = "<p id=x><dfn>Access token</dfn> is a secret.</p><p>Clients MUST guard each access token.</p><p>Servers SHOULD log failures.</p>"
    docs = pages(spark, old, old.replace("a secret", "an opaque secret"))
    versions = spark.createDataFrame([("spec", i, f"s{i}", str(i)) for i in range(2)], "standard string, seq int, document_sha256 string, document_version string")
    edges, links, seeded = diff.chain(extract(docs), versions, definitions.definitions(docs))
    rows = edges.collect()
    assert sorted(r["relation"] for r in rows) == ["CONTINUES", "CONTINUES", "DEFINITION_CHANGED", "DEPENDS_ON", "REFERENCES_DEFINITION"]
    assert all((r["to_version"], r["step"]) == ("1", 0) for r in rows)
    by = {r["relation"]: r for r in rows}
    assert by["DEFINITION_CHANGED"]["term"] == "Access token"
    assert by["DEPENDS_ON"]["from_lineage_id"] == by["REFERENCES_DEFINITION"]["from_lineage_id"]
    assert lineage.violations(edges, lineage.instances(edges, seeded, versions)).count() == 0
    assert lineage.ambiguity(links).count() == 0


def test_definitions(spark):
    old = "<p id=x><dfn>Access token</dfn> is a secret.</p><p>Clients MUST guard each access token.</p>"
    new = old.replace("a secret", "an opaque secret") + "<p><dfn>Vault</dfn> stores it.</p>"
    docs = pages(spark, old, new)
    defs = definitions.definitions(docs).withColumn("pair", F.lit(1))
    assert {r["term"] for r in defs.where("document_sha256 = 's1'").collect()} == {"Access token", "Vault"}
    a, b = defs.where("document_sha256 = 's0'"), defs.where("document_sha256 = 's1'")
    assert {(r["term_key"], r["kind"]) for r in definitions.transitions(a, b, ["pair"]).collect()} == {("access token", "CHANGED"), ("vault", "ADDED")}
    links = definitions.links(extract(docs), defs)
    assert sorted(r["document_version"] for r in links.collect()) == ["0", "1"]


@pytest.mark.parametrize(
    ("html", "problem"),
    [
        (OLD, None),
        ("<p>a<p>b", None),
        ("<b>a", "<b> is never closed"),
        ("a</b>", "unexpected </b>"),
        ("", "empty"),
        ("<p>a\x01</p>", "control character"),
        ("<p>a</p><di", "unfinished markup at the end"),
    ],
)
def test_gate(html, problem):
    assert scan.html_problem(html) == problem


def test_families():
    assert scan.family_of(OLD) == []
    assert scan.family_of('<html><head><title>RFC 9999 X</title></head><body><div class="rfc"><p>x</p></div></body></html>') == ["rfc"]
    assert scan.family_of('<link rel="canonical" href="https://www.w3.org/TR/x/"><div class="head">W3C Recommendation</div>') == ["w3c"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text(OLD)
    (tmp_path / "a.html.meta.json").write_text('{"etag": "x", "more": "y"}')
    (tmp_path / "b.html").write_bytes(b"a\xff")
    docs = scan.documents(spark, str(tmp_path))
    assert {r["rejected"] for r in docs.collect()} == {None, "not UTF-8"}
    row = scan.with_provenance(docs.where("rejected is null"), scan.sidecars(spark, str(tmp_path))).first()
    assert row["etag"] == "x" and row["fetch_metadata"] == {"more": "y"}
    out = scan.sources(docs).first()
    assert (out["document_version"], out["document_family"], out["quarantine"]) == ("1.0", "generic_html", None)


def test_scoring(spark):
    gold = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "k int, label string")
    said = spark.createDataFrame([(1, "A"), (2, "B"), (9, "A")], "k int, label string")
    rows = {r["label"]: (r["tp"], r["fp"], r["fn"], r["support"]) for r in scoring.confusion(gold, said, ["k"]).collect()}
    assert rows == {"A": (1, 1, 1, 2), "B": (0, 1, 1, 1)}
    m = scoring.with_metrics(spark.createDataFrame([(0, 0, 0), (1, 1, 0)], "tp int, fp int, fn int")).collect()
    assert [(r["precision"], r["recall"], r["f1"]) for r in m] == [(1.0, 1.0, 1.0), (0.5, 1.0, 0.6667)]
    g = spark.createDataFrame([("c", 0, "retry"), ("c", 1, "retry")], "c string, position long, contains string")
    f = spark.createDataFrame([("c", 0, "We RETRY"), ("c", 1, "no")], "c string, position long, text string")
    assert [(r[1], r[2]) for r in scoring.first_fit(g, f, "c").orderBy("gold_position").collect()] == [(0, 0), (1, None)]


def test_structural_form(spark):
    reqs = classify.prepared(extract(pages(spark, OLD, NEW))).withColumn("pair", F.lit(1))
    rows = classify.dimensions(diff.aligned(reqs.where("document_sha256 = 's0'"), reqs.where("document_sha256 = 's1'"), ["pair"])).collect()
    assert sorted(r["structural_form"] for r in rows) == ["MOVED_AND_REWRITTEN", "MOVE_ONLY", "NONE", "REWRITE_ONLY", "REWRITE_ONLY"]
