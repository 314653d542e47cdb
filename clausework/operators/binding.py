"""Binding rows of different origin to each other, and the reports over them.

Everything is a join, an aggregation or a Column expression; rows that cannot be bound come back with
the reason, they are never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions import text as T

#: Place of a missing side in the order of pairs.
FAR = 10_000


def required_family(sources: DataFrame, family: str, column: str = "family") -> DataFrame:
    """Sources with `reason`: null where they are of the family, else why they are not taken."""
    other = F.concat(F.lit(f"{family} required, found "), F.coalesce(F.col(column), F.lit("none")))
    return sources.withColumn("reason", F.when(~F.col(column).eqNullSafe(F.lit(family)), other))


def without_body(sources: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Sources that have no block with a visible sign."""
    return sources.join(blocks.where(F.length(T.normalize_whitespace("text")) > 0).select(key).distinct(), key, "left_anti")


def prefix_bindings(value: Column) -> Column:
    """Map of prefix to address from an RDFa prefix attribute; null where a prefix is bound twice."""
    found = F.regexp_extract_all(value, F.lit(r"([^\s:]+):\s+(\S+)"), 1), F.regexp_extract_all(value, F.lit(r"([^\s:]+):\s+(\S+)"), 2)
    names = F.transform(found[0], F.lower)
    return F.when(F.size(names) == F.size(F.array_distinct(names)), F.map_from_arrays(names, found[1]))


def same_address(acquired: Column, redirects: Column, canonical: Column) -> Column:
    """Whether the address a source came from, and every redirect on the way, is the canonical one."""
    return acquired.eqNullSafe(canonical) & F.forall(F.coalesce(redirects, F.array().cast("array<string>")), lambda r: r.eqNullSafe(canonical))


def all_actual(sources: Column) -> Column:
    """Whether all of an item's sources, and one at least, are actual ones."""
    return F.coalesce(F.forall(sources, lambda s: s["origin"] == "ACTUAL") & (F.size(sources) > 0), F.lit(False))


def unknown_slots(rows: DataFrame, ontology: DataFrame, slot: str = "slot", value: str = "value") -> DataFrame:
    """Rows whose slot is not known, or whose value is not one of its slot's."""
    known = ontology.select(F.col("slot").alias(slot), F.col("value").alias(value)).distinct()
    slots = known.select(F.col(slot).alias("_slot")).distinct()
    out = rows.join(known, [slot, value], "left_anti").join(slots, F.col(slot) == F.col("_slot"), "left")
    return out.withColumn("reason", F.when(F.col("_slot").isNull(), "slot").otherwise("value")).drop("_slot")


def ambiguous_terms(defs: DataFrame, keys: list[str]) -> DataFrame:
    """Terms, whatever their case, that a version defines more than once."""
    return defs.groupBy(*keys, F.lower("term").alias("term_key")).agg(F.count("*").alias("definitions")).where("definitions > 1")


def resolved_changes(changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes with the texts of their two requirements, and `bound`: whether every id they name was found."""
    left = old.select(F.col("requirement_id").alias("old_id"), F.col("text").alias("old_text"), F.lit(True).alias("_old"))
    right = new.select(F.col("requirement_id").alias("new_id"), F.col("text").alias("new_text"), F.lit(True).alias("_new"))
    out = changes.join(left, "old_id", "left").join(right, "new_id", "left")
    found = (F.col("old_id").isNull() | F.col("_old").isNotNull()) & (F.col("new_id").isNull() | F.col("_new").isNotNull())
    return out.withColumn("bound", found).drop("_old", "_new")


def packet_items(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Packet items (item_id, shas, scope) and the split's documents of their hashes: one row a hash, `problem` null where it is bound."""
    told = items.select("item_id", "scope", F.explode_outer("shas").alias("sha"))
    known = documents.select("sha", F.col("scope").alias("document_scope"), F.lit(True).alias("_known"))
    out = told.join(known, "sha", "left")
    problem = F.when(F.col("sha").isNull(), "no hash").when(F.col("_known").isNull(), "unknown document").when(~F.col("scope").eqNullSafe(F.col("document_scope")), "other scope")
    return out.withColumn("problem", problem).select("item_id", "sha", "problem")


def bound_votes(votes: DataFrame, submissions: DataFrame) -> DataFrame:
    """Votes (item_id, annotator, submission_sha) with `problem`: a submission that is unknown, of another annotator, or voted from twice for an item."""
    known = submissions.select(F.col("sha").alias("submission_sha"), F.col("annotator").alias("author"))
    times = F.count("*").over(Window.partitionBy("item_id", "submission_sha"))
    out = votes.withColumn("_times", times).join(known, "submission_sha", "left")
    problem = F.when(F.col("author").isNull(), "unknown submission").when(F.col("author") != F.col("annotator"), "other annotator").when(F.col("_times") > 1, "repeated")
    return out.withColumn("problem", problem).drop("_times", "author")


def observation(value: Column, *evidence: Column) -> Column:
    """A value with its hash and the hash of what it was seen in."""
    return F.struct(value.alias("value"), F.sha2(F.coalesce(value, F.lit("")), 256).alias("value_sha256"), T.digest(*evidence).alias("evidence_sha256"))


def change_kinds(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The different classes of changes, in order."""
    return changes.groupBy(*keys).agg(F.array_sort(F.collect_set("classification")).alias("classes"))


def in_pair_order(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with their place: by the smaller index, a missing side counting as far, then old and new id, a missing one as empty."""
    first = F.least(F.coalesce("old_index", F.lit(FAR)), F.coalesce("new_index", F.lit(FAR)))
    order = Window.partitionBy(*keys).orderBy(first, F.coalesce("old_id", F.lit("")), F.coalesce("new_id", F.lit("")))
    return pairs.withColumn("place", F.row_number().over(order))


def in_definition_order(defs: DataFrame, keys: list[str]) -> DataFrame:
    """Definitions with their place: by term whatever its case, then id."""
    return defs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lower("term"), "definition_id")))


def relation_counts(edges: DataFrame, *keys: str) -> DataFrame:
    return edges.groupBy(*keys, "relation").agg(F.count("*").alias("n"))


def graph_summary(nodes: DataFrame, edges: DataFrame, defs: DataFrame, linked: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """One row: lineages, nodes, edges, relations, definitions, links and ambiguities of a graph."""
    parts = [
        nodes.agg(F.count_distinct("lineage_id").alias("lineages"), F.count("*").alias("nodes")),
        edges.agg(F.count("*").alias("edges"), F.count_distinct("relation").alias("relations")),
        *(df.agg(F.count("*").alias(name)) for df, name in ((defs, "definitions"), (linked, "links"), (ambiguous, "ambiguities"))),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def alignment_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 of alignments over positive pairs alone; pairs: expected and found flags. 1 where there is nothing to find or nothing was."""
    rate = lambda hit, of: F.when(of == 0, 1.0).otherwise(hit / of)
    out = pairs.groupBy(*keys).agg(F.count_if(F.col("expected") & F.col("found")).alias("hits"), F.count_if("expected").alias("expected"), F.count_if("found").alias("found"))
    out = out.withColumn("precision", rate(F.col("hits"), F.col("found"))).withColumn("recall", rate(F.col("hits"), F.col("expected")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def metrics_json(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metric rows as canonical JSON texts, keys in order."""
    rest = sorted(c for c in metrics.columns if c not in keys)
    return metrics.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))
