"""Command line: python -m clausework.cli COMMAND. Exit codes: 0 fine, 1 does not hold, 2 bad input."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators import definitions, lineage, verify
from clausework.operators.extract import extract
from clausework.plans import diff
from clausework.sources import scan


class InputError(Exception):
    """What the user gave cannot be used."""


def session() -> SparkSession:
    return SparkSession.builder.appName("clausework").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The documents in the order given, gated; seq counts them."""
    out = None
    for i, path in enumerate(paths):
        try:
            docs = scan.sources(scan.documents(spark, path, "*")).withColumn("seq", F.lit(i))
            row = docs.select("quarantine", "document_family").first()
        except Exception as e:
            raise InputError(f"{path}: {str(e).splitlines()[0]}") from e
        if row is None:
            raise InputError(f"{path}: empty or not UTF-8")
        if row["quarantine"]:
            raise InputError(f"{path}: {row['quarantine']}")
        if row["document_family"] is None:
            raise InputError(f"{path}: shows several families")
        out = docs if out is None else out.unionByName(docs)
    return out


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def make_report(spark: SparkSession, old: str, new: str, profile: str) -> dict:
    docs = load(spark, [old, new])
    reqs = extract(docs, profile).withColumn("pair", F.lit(0))
    shas = [r["document_sha256"] for r in docs.orderBy("seq").select("document_sha256").collect()]
    changes = diff.diff(*(reqs.where(F.col("document_sha256") == s) for s in shas), ["pair"]).drop("pair")
    found = rows(changes)
    counts: dict[str, int] = {}
    for c in found:
        counts[c["classification"]] = counts.get(c["classification"], 0) + 1
    return verify.report({"schema_version": "1", "profile": profile, "documents": shas}, rows(reqs.drop("pair")), found, counts)


def command(args: argparse.Namespace) -> int:
    spark = session()
    if args.command == "extract":
        out = {"requirements": rows(extract(load(spark, [args.path]), args.profile).orderBy("structural_index", "source_locator", "requirement_id"))}
    elif args.command == "ingest":
        out = {"sources": rows(load(spark, [args.path]).drop("html"))}
    elif args.command == "diff":
        value = make_report(spark, args.old, args.new, args.profile)
        files = {p: make(value) for p, make in ((args.json, verify.canonical_bytes), (args.markdown, lambda v: verify.markdown(v).encode())) if p}
        verify.write_files(files)
        return 0
    elif args.command == "verify":
        with open(args.report, "rb") as f:
            claimed = f.read()
        try:
            profile = verify.strict_loads(claimed).get("profile", "rfc2119")
        except (verify.StrictError, AttributeError) as e:
            print(e, file=sys.stderr)
            return 1
        problems = verify.report_problems(claimed, make_report(spark, args.old, args.new, profile))
        print("\n".join(problems), file=sys.stderr)
        return int(bool(problems))
    elif args.command == "lineage":
        docs = load(spark, args.paths).withColumn("standard", F.lit("spec"))
        edges, links, _ = diff.chain(extract(docs, args.profile), docs.select("standard", "seq", "document_sha256", "document_version"), definitions.definitions(docs))
        out = {"edges": rows(edges.orderBy("step", "edge_id")), "ambiguity": rows(lineage.ambiguity(links).orderBy("item_id"))}
    else:
        docs = load(spark, [args.old, args.new]).withColumn("pair", F.lit(0))
        defs = definitions.definitions(docs).join(docs.select("document_sha256", "seq", "pair"), "document_sha256")
        out = {"transitions": rows(definitions.transitions(defs.where("seq = 0"), defs.where("seq = 1"), ["pair"]).drop("pair").orderBy("transition_id"))}
    data = verify.canonical_bytes(out)
    if args.out:
        verify.write_files({args.out: data})
    else:
        sys.stdout.buffer.write(data)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clausework")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, places in (("extract", ["path"]), ("ingest", ["path"]), ("diff", ["old", "new"]), ("verify", ["report", "old", "new"]), ("lineage", ["paths"]), ("definition-transitions", ["old", "new"])):
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place, nargs="+" if place == "paths" else None)
        p.add_argument("--profile", choices=["rfc2119", "whatwg"], default="rfc2119")
        p.add_argument("--out")
        if name == "diff":
            p.add_argument("--json")
            p.add_argument("--markdown")
    try:
        return command(parser.parse_args(argv))
    except InputError as e:
        print(e, file=sys.stderr)
        return 2
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
