"""Requirements from text blocks: modals, then roles and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.functions.modals import modals
from clausework.functions.roles import with_roles
from clausework.sources.markup import explode_blocks


def requirements(blocks: DataFrame, profile: str = "rfc2119") -> DataFrame:
    """One row for each modal that speaks for the current text, of blocks that are not informative.

    blocks: document_sha256, document_version, text, section_path, locator, structural_index,
    is_informative, spans. The filters come before the Python stage, so it sees as few rows as can be:
    a block without any keyword's letters never reaches it.
    """
    hint = r"(?i)must|shall|should|required|recommended|may|optional" if profile == "whatwg" else "MUST|SHALL|SHOULD|REQUIRED|RECOMMENDED|MAY|OPTIONAL"
    spoken = blocks.where(~F.col("is_informative") & F.col("text").rlike(hint))
    found = spoken.select("*", F.explode(modals(F.col("text"), profile, F.col("spans"))).alias("m")).where(~F.col("m.historical"))
    flat = found.select("*", *[F.col(f"m.{c}").alias(c) for c in ("modality", "polarity", "start", "clause", "clause_start", "clause_end")])
    roles = with_roles(flat).withColumn("normalized_text", T.normalize_whitespace("clause"))
    return roles.select(
        T.requirement_id("document_sha256", "locator", "modality", "start", "normalized_text").alias("requirement_id"),
        "document_sha256",
        "document_version",
        "section_path",
        F.col("locator").alias("source_locator"),
        F.col("text").alias("original_text"),
        "normalized_text",
        "modality",
        "polarity",
        "actor",
        "action",
        "condition",
        "exception",
        T.confidence("action", "condition", "exception").alias("confidence"),
        T.fingerprint("normalized_text", "modality", "actor", "action", "condition", "exception").alias("fingerprint"),
        "structural_index",
    )


def extract(sources: DataFrame, profile: str = "rfc2119") -> DataFrame:
    """Requirements of documents: document_sha256, document_version, html."""
    return requirements(explode_blocks(sources.select("document_sha256", "document_version", "html")), profile)
