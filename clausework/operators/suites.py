"""Case suites: every case's two documents are extracted, aligned and classed at once, then scored."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators import scoring
from clausework.operators.extract import extract
from clausework.operators.verify import canonical_bytes
from clausework.plans import diff


def changes_of(cases: DataFrame, profile: str) -> DataFrame:
    """Change rows of every case (id, old, new: html). A document's hash is told apart by its case."""
    pages = cases.select("id", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old").alias("html")), F.struct(F.lit("new").alias("side"), F.col("new").alias("html")))).alias("p"))
    docs = pages.select("id", "p.side", "p.html", F.sha2(F.concat_ws("|", "id", "p.side", "p.html"), 256).alias("document_sha256"), F.col("p.side").alias("document_version"))
    reqs = extract(docs, profile).join(docs.select("id", "side", "document_sha256"), "document_sha256")
    return diff.diff(reqs.where("side = 'old'").drop("side"), reqs.where("side = 'new'").drop("side"), ["id"])


def run(cases: DataFrame) -> DataFrame:
    """Results of a suite. cases: id, profile, old, new, expected and forbidden (arrays of classes), focus (array of texts), allow_extra.

    With a focus only changes count whose texts or transition hold one of it, whatever the case.
    """
    found = None
    for profile in ("rfc2119", "whatwg"):
        part = changes_of(cases.where(F.col("profile") == profile), profile)
        found = part if found is None else found.unionByName(part)
    blob = F.lower(F.concat_ws(" ", "old_text", "new_text", "modality_transition"))
    wanted = found.withColumn("blob", blob).join(cases.select("id", "focus"), "id")
    focused = wanted.where((F.size("focus") == 0) | F.exists("focus", lambda s: F.contains(F.col("blob"), F.lower(s))))
    actual = focused.select("id", F.col("classification").alias("label"))
    expected = cases.select("id", F.explode("expected").alias("label"))
    forbidden = cases.select("id", F.explode("forbidden").alias("label"))
    return scoring.with_metrics(scoring.case_passes(expected, actual, forbidden, cases.select("id", "allow_extra"), ["id"]))


def item_key(task: str, slot: str, evidence: list[str]) -> str:
    """Key of an acceptance item: SHA-256 of the canonical JSON of what it is about."""
    return hashlib.sha256(canonical_bytes({"evidence": sorted(evidence), "slot": slot, "task": task})).hexdigest()


def locator_problem(locator: Column) -> Column:
    """Why a locator is not portable: not in NFC, control characters, white space at its ends; null if it is."""

    @F.pandas_udf("string")
    def run_(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return "empty"
            if t != unicodedata.normalize("NFC", t):
                return "not NFC"
            if any(unicodedata.category(c) in ("Cc", "Cf", "Cs") for c in t):
                return "control character"
            return "white space at its ends" if t != t.strip() else None

        return texts.map(one)

    return run_(locator)
