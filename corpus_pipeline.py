"""A training corpus from `documents`: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.common import prepare, stage, table
from clausework.llm.decontamination import contaminated
from clausework.llm.near_dedup import first_of_class
from clausework.llm.sentence_pieces import segment
from clausework.llm.suffix_dedup import remove_repeats, whole_characters
from clausework.llm.toxicity import fit, score, training_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores at 0.5 or more go."""
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, model, into="_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: the one with the smallest id, rows without an id coming last.

    Rows are told apart by id and text, so another text of the same id stays if its own class is another.
    """
    return first_of_class(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has go from the text, with the rests of characters they cut."""
    prepare(spark)
    cut = remove_repeats(docs).withColumn("text", F.when(F.col("n_removed") > 0, whole_characters(F.col("kept"))).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go, with or without an id; another text of the same id stays."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    hits = contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(stage(hits.select(F.col("doc_id").alias("_key")).distinct(), "hits"), "_key", "left_anti").select(*docs.columns)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with a sampled segmentation."""
    prepare(spark)
    return segment(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", sample_pieces),
]

#: No stage but the exact removal of passages can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
