"""Canonical JSON, strict JSON, integrity hashes, reports and their replay; evidence inventories."""

from __future__ import annotations

import hashlib
import json
import math
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StrictError(ValueError):
    """JSON that a careful reader must refuse."""


def canonical_bytes(value) -> bytes:
    """Keys sorted, two blanks of indent, unescaped UTF-8, a line end last."""
    return (json.dumps(value, sort_keys=True, indent=2, separators=(",", ": "), ensure_ascii=False, allow_nan=False) + "\n").encode()


def integrity_hash(value: dict) -> str:
    """SHA-256 of the canonical bytes without the `integrity` key."""
    return hashlib.sha256(canonical_bytes({k: v for k, v in value.items() if k != "integrity"})).hexdigest()


def _pairs(pairs: list) -> dict:
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise StrictError(f"duplicate key {next(k for k in keys if keys.count(k) > 1)!r}")
    return dict(pairs)


def _float(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise StrictError(f"number out of range {text}")
    if x == 0 and text.startswith("-"):
        raise StrictError("negative zero")
    return x


def _int(text: str) -> int:
    if text == "-0":
        raise StrictError("negative zero")
    return int(text)


def _constant(text: str):
    raise StrictError(f"constant {text}")


def strict_loads(text: str | bytes):
    """JSON without duplicate keys, NaN, infinities or negative zeros."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    try:
        return json.loads(text, object_pairs_hook=_pairs, parse_float=_float, parse_int=_int, parse_constant=_constant)
    except json.JSONDecodeError as e:
        raise StrictError(str(e)) from e


def strict_problem(column):
    """Column: why a JSON text is refused; null if it is sound."""

    def problem(text: str | None) -> str | None:
        try:
            strict_loads(text or "")
        except (StrictError, RecursionError) as e:
            return str(e) or "too deep"
        return None

    @F.arrow_udf("string")
    def problems(texts: pa.Array) -> pa.Array:
        return pa.array([problem(t) for t in texts.to_pylist()], pa.string())

    return problems(column)


def write_files(files: dict[str, bytes]) -> None:
    """Several files, all or none: written beside their places, then moved; if a move fails, what was there comes back and what was not goes."""
    staged, kept, fresh = {}, {}, []
    paths = [os.path.realpath(p) for p in files]
    if len(set(paths)) != len(paths) or any(a != b and b.startswith(a + os.sep) for a in paths for b in paths):
        raise ValueError("outputs collide")
    try:
        for path, data in files.items():
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            fd, staged[path] = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
            with os.fdopen(fd, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        for path in files:
            if os.path.exists(path):
                if not os.path.isfile(path):
                    raise ValueError(f"not a regular file: {path}")
                with open(path, "rb") as f:
                    kept[path] = f.read()
            os.replace(staged[path], path)
            del staged[path]
            if path not in kept:
                fresh.append(path)
    except BaseException:
        for path in fresh:
            os.unlink(path)
        for path, data in kept.items():
            with open(path, "wb") as f:
                f.write(data)
        for path in staged.values():
            os.unlink(path)
        raise


def report(header: dict, requirements: list[dict], changes: list[dict], counts: dict[str, int]) -> dict:
    """A report with its integrity hash; the lists in a total order."""
    body = {
        **header,
        "requirements": sorted(requirements, key=lambda r: (r["document_sha256"], r["structural_index"], r["source_locator"], r["requirement_id"])),
        "changes": sorted(changes, key=lambda c: (c["classification"], c["old_requirement_id"] or "", c["new_requirement_id"] or "", c["change_id"])),
        "summary": {"counts": dict(sorted(counts.items())), "total": len(changes)},
    }
    return {**body, "integrity": {"algorithm": "sha256", "sha256": integrity_hash(body)}}


def report_problems(claimed: bytes, replayed: dict) -> list[str]:
    """Why a report does not hold: strict parsing, its own hash, then equality with a replay from the sources."""
    try:
        value = strict_loads(claimed)
    except (StrictError, UnicodeDecodeError) as e:
        return [f"not strict JSON: {e}"]
    out = []
    if not isinstance(value, dict) or value.get("integrity", {}).get("sha256") != integrity_hash(value):
        out.append("integrity hash does not match")
    if canonical_bytes(value) != claimed:
        out.append("not in canonical form")
    if canonical_bytes(value) != canonical_bytes(replayed):
        out.append("differs from the replay")
    ids = {r["requirement_id"] for r in value.get("requirements", [])} if isinstance(value, dict) else set()
    for c in value.get("changes", []) if isinstance(value, dict) else []:
        for side in ("old_requirement_id", "new_requirement_id"):
            if c.get(side) and c[side] not in ids:
                out.append(f"{c.get('change_id')}: {side} is not among the requirements")
    return out


def markdown(value: dict) -> str:
    """A report for readers: counts, then one line for each change."""
    lines = ["# Changes", "", "| Class | Count |", "| --- | --- |", *[f"| {k} | {n} |" for k, n in value["summary"]["counts"].items()], ""]
    lines += [f"- **{c['classification']}** ({c['confidence']:.2f}) {c.get('modality_transition') or ''}: `{c['old_requirement_id'] or '∅'}` → `{c['new_requirement_id'] or '∅'}`" for c in value["changes"]]
    return "\n".join(lines) + "\n"


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Lines `sha256  relative/path` of an inventory file as rows."""
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", 2).alias("ref")).where("sha256 <> ''")


def inventory_problems(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Files missing, unlisted or changed. listed and found: ref, sha256."""
    both = listed.withColumnRenamed("sha256", "listed").join(found.withColumnRenamed("sha256", "found"), "ref", "full_outer")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("listed") != F.col("found"), "changed")
    return both.select("ref", reason.alias("problem")).where("problem is not null")
