"""Manifests of sources: one JSON object with a list of records. Checks come as rows: a problem and what it is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import text as T
from clausework.operators import scoring

RECORD = "source_id string, document_family string, standard_id string, version string, canonical_url string, output_ref string, sha256 string, byte_length long, retrieved_at string"
MANIFEST = f"schema_version string, policy_sha256 string, sources array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in RECORD.split(','))}>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The records of a manifest file."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("sources"))


def problems(records: DataFrame, most_bytes: int = 50_000_000) -> DataFrame:
    """What is wrong with a manifest: repeated ids, references (whatever their case) or hashes, URLs and references out of form, sizes, times, families with too little variety."""
    say = lambda df, what, item: df.select(F.lit(what).alias("problem"), F.col(item).cast("string").alias("item"))
    out = [say(scoring.duplicates(records, k), f"repeated {k}", k) for k in ("source_id", "sha256")]
    out.append(say(scoring.duplicates(records.withColumn("ref", F.lower("output_ref")), "ref"), "repeated output_ref", "ref"))
    out.append(say(records.where(~T.exact_https_url("canonical_url")), "URL out of form", "source_id"))
    out.append(say(records.where(T.portable_ref_problem("output_ref").isNotNull()), "reference out of form", "source_id"))
    out.append(say(records.where(F.coalesce(~F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(True))), "hash out of form", "source_id"))
    out.append(say(records.where(F.coalesce((F.col("byte_length") <= 0) | (F.col("byte_length") > most_bytes), F.lit(True))), "size out of bounds", "source_id"))
    out.append(say(records.where(T.utc_second("retrieved_at").isNull()), "time out of form", "source_id"))
    out.append(say(scoring.diversity(records, "document_family", "standard_id", "version").where("not ok"), "too little variety", "document_family"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def replay(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records against the files found (ref, sha256, byte_length): missing, changed, unlisted."""
    left = records.select(F.col("output_ref").alias("ref"), F.col("sha256").alias("want"), F.col("byte_length").alias("size"))
    both = left.join(found, "ref", "full_outer")
    reason = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when((F.col("want") != F.col("sha256")) | (F.col("size") != F.col("byte_length")), "changed")
    return both.select("ref", reason.alias("problem")).where("problem is not null")
