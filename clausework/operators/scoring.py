"""Scoring of predictions: precision, recall and F1, label multisets, gates with exact ratios, governance checks. Native but for ordered gold matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp > 0, F.round(tp / (tp + fp), 4)).when(fn == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def recall(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, F.round(tp / (tp + fn), 4)).when(fp == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp, fn), recall(tp, fp, fn)
    return F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", precision(tp, fp, fn).alias("precision"), recall(tp, fp, fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


def confusion(gold: DataFrame, predictions: DataFrame, keys: list[str], label: str = "label", none: str = "NONE") -> DataFrame:
    """tp, fp, fn and support by label. A key without a prediction counts as `none`; predictions without gold are false positives."""
    joined = gold.select(*keys, F.col(label).alias("gold")).join(predictions.select(*keys, F.col(label).alias("said")), keys, "full_outer")
    sides = joined.select(F.coalesce("gold", F.lit(none)).alias("gold"), F.coalesce("said", F.lit(none)).alias("said"))
    rows = sides.select(F.explode(F.array_distinct(F.array("gold", "said"))).alias(label), "gold", "said").where(F.col(label) != none)
    hit, miss = F.col("gold") == F.col(label), F.col("said") == F.col(label)
    return rows.groupBy(label).agg(F.count_if(hit & miss).alias("tp"), F.count_if(~hit & miss).alias("fp"), F.count_if(hit & ~miss).alias("fn"), F.count_if(hit).alias("support"))


def multiset_counts(expected: DataFrame, actual: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """tp = sum of the smaller counts, fn and fp = what is left over, for each case."""
    e, a = (d.groupBy(*keys, label).agg(F.count("*").alias(n)) for d, n in ((expected, "e"), (actual, "a")))
    both = e.join(a, [*keys, label], "full_outer").fillna(0, ["e", "a"])
    return both.groupBy(*keys).agg(F.sum(F.least("e", "a")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"))


def case_passes(expected: DataFrame, actual: DataFrame, forbidden: DataFrame, options: DataFrame, keys: list[str]) -> DataFrame:
    """Does a case hold: all expected labels there (exactly them, unless it allows more), none forbidden."""
    counts = multiset_counts(expected, actual, keys)
    bad = actual.join(forbidden, [*keys, "label"], "left_semi").groupBy(*keys).agg(F.count("*").alias("bad"))
    out = options.join(counts, keys, "left").join(bad, keys, "left").fillna(0, ["tp", "fp", "fn", "bad"])
    return out.withColumn("passed", (F.col("fn") == 0) & (F.col("bad") == 0) & (F.col("allow_extra") | (F.col("fp") == 0)))


def roll_up(results: DataFrame) -> DataFrame:
    passed = F.count_if("passed")
    return results.agg(F.count("*").alias("case_count"), passed.alias("passed"), (F.count("*") - passed).alias("failed"), F.round(passed / F.count("*"), 4).alias("pass_rate"))


def macro(metrics: DataFrame, *names: str) -> DataFrame:
    return metrics.agg(*[F.round(F.avg(n), 4).alias(n) for n in names])


def first_fit(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Gold substrings matched to texts, one to one: in gold order, each takes the first free text that contains it. gold: key, position, contains; found: key, position, text."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free, out = right.sort_values("position").to_dict("records"), []
        for g in left.sort_values("position").to_dict("records"):
            hit = next((f for f in free if g["contains"].lower() in f["text"].lower()), None)
            if hit is not None:
                free.remove(hit)
            out.append((g[key], g["position"], None if hit is None else hit["position"]))
        return pd.DataFrame(out, columns=[key, "gold_position", "found_position"])

    kind = gold.schema[key].dataType.simpleString()
    return gold.groupBy(key).cogroup(found.groupBy(key)).applyInPandas(run, f"{key} {kind}, gold_position long, found_position long")


def gate_results(counts: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates over counts by label: enough support, and every ratio at its threshold by integer cross-multiplication (threshold in hundredths; nothing over nothing passes 0 only)."""
    joined = gates.join(counts, "label", "left").fillna(0, ["tp", "fp", "fn", "support"])
    ratios = {"precision": (F.col("tp"), F.col("tp") + F.col("fp")), "recall": (F.col("tp"), F.col("tp") + F.col("fn")), "f1": (2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))}
    meets = {n: F.when(d == 0, F.col("threshold") == 0).otherwise(a * 100 >= F.col("threshold") * d) for n, (a, d) in ratios.items()}
    out = joined.select("*", *[m.alias(f"{n}_ok") for n, m in meets.items()], (F.col("support") >= F.col("min_support")).alias("support_ok"))
    return out.withColumn("passed", F.col("support_ok") & F.col("precision_ok") & F.col("recall_ok") & F.col("f1_ok"))


def phases(results: DataFrame) -> DataFrame:
    return results.groupBy("phase").agg(F.bool_and("passed").alias("passed"), F.count("*").alias("gates"))


# Governance.


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def exact_cover(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, as multisets."""
    return left.exceptAll(right).withColumn("only", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only", F.lit("right")))


def leaks(split: DataFrame, key: str, part: str = "split") -> DataFrame:
    """Keys in more than one part of a split."""
    return split.groupBy(key).agg(F.array_sort(F.collect_set(part)).alias("parts")).where(F.size("parts") > 1)


def holdout_rule(split: DataFrame, family: str, part: str = "split") -> DataFrame:
    """At least 40 % of each family's chains held out, in whole numbers."""
    out = split.groupBy(family).agg(F.count_if(F.col(part) == "holdout").alias("holdout"), F.count("*").alias("n"))
    return out.withColumn("ok", F.col("holdout") * 5 >= F.col("n") * 2)


def diversity(rows: DataFrame, family: str, *keys: str, least: int = 2) -> DataFrame:
    out = rows.groupBy(family).agg(*[F.count_distinct(k).alias(k) for k in keys])
    ok = F.lit(True)
    for k in keys:
        ok = ok & (F.col(k) >= least)
    return out.withColumn("ok", ok)


def revision_breaks(decisions: DataFrame, item: str, revision: str, supersedes: str | None = None, decision: str | None = None) -> DataFrame:
    """Decisions whose revisions have a gap, or that do not supersede their predecessor."""
    order = Window.partitionBy(item).orderBy(revision)
    rows = decisions.withColumn("expected", F.row_number().over(order))
    broken = F.col(revision) != F.col("expected")
    if supersedes:
        broken = broken | ~F.col(supersedes).eqNullSafe(F.lag(decision).over(order))
    return rows.withColumn("broken", broken).where("broken").drop("broken")


def overlapping_rounds(rounds: DataFrame, item: str) -> DataFrame:
    """Review rounds that open before the one before is complete. rounds: round, opened_at, completed_at."""
    order = Window.partitionBy(item).orderBy("round")
    return rounds.withColumn("previous", F.lag("completed_at").over(order)).where("previous is not null and opened_at <= previous")
