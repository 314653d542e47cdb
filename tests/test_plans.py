from __future__ import annotations

import json

from clausework import cli
from clausework.streaming import versions

from tests.test_documents import NEW, OLD


def test_cli(spark, tmp_path, capsysbinary):
    old, new = tmp_path / "old.html", tmp_path / "new.html"
    old.write_text(OLD)
    new.write_text(NEW)
    report = tmp_path / "report.json"
    assert cli.main(["diff", str(old), str(new), "--json", str(report), "--markdown", str(tmp_path / "report.md")]) == 0
    value = json.loads(report.read_bytes())
    assert value["summary"]["counts"] == {"ADDED": 1, "EXCEPTION_ADDED": 1, "MOVED": 1, "POLARITY_FLIP": 1, "WEAKENED": 1}
    assert cli.main(["verify", str(report), str(old), str(new)]) == 0
    report.write_bytes(report.read_bytes().replace(b"WEAKENED", b"REMOVED"))
    assert cli.main(["verify", str(report), str(old), str(new)]) == 1
    (tmp_path / "bad.html").write_text("<b>never closed")
    assert cli.main(["extract", str(tmp_path / "bad.html")]) == 2
    capsysbinary.readouterr()
    assert cli.main(["extract", str(old)]) == 0
    assert len(json.loads(capsysbinary.readouterr().out)["requirements"]) == 4


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda seq, html: json.dumps(dict(standard="spec", seq=seq, document_version=str(seq), html=html))
    for name, rows in (("a", [line(1, OLD)]), ("b", [line(3, NEW), line(2, OLD)]), ("c", [line(2, NEW)])):
        (folder / f"{name}.json").write_text("\n".join(rows))
        versions.run(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/requirements")).groupBy("document_version").count().collect()
    assert {r["document_version"]: r["count"] for r in got} == {"1": 4, "2": 4, "3": 5}
    assert [r["seq"] for r in spark.read.parquet(str(tmp_path / "out/quarantine")).collect()] == [2]
