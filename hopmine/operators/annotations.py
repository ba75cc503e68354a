"""Reviewer agreement, majority votes, validity counts and exact-match scores.

Annotations are one row per (item_id, reviewer) with answerable and multi_hop; a missing flag is false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agreement(notes: DataFrame) -> DataFrame:
    """(a, b, n_agree, n_items) of every ordered pair of reviewers over the items that both have: both valid or both not."""
    valid = notes.select("item_id", "reviewer", (F.coalesce("answerable", F.lit(False)) & F.coalesce("multi_hop", F.lit(False))).alias("valid"))
    other = valid.select("item_id", F.col("reviewer").alias("b"), F.col("valid").alias("valid_b"))
    return valid.withColumnRenamed("reviewer", "a").join(other, "item_id").groupBy("a", "b").agg(F.count_if(F.col("valid") == F.col("valid_b")).alias("n_agree"), F.count("*").alias("n_items"))


def agreement_matrix(notes: DataFrame, reviewers: list[str]) -> DataFrame:
    """One row per reviewer, one column per reviewer; null where a reviewer has no items."""
    return agreement(notes).groupBy("a").pivot("b", reviewers).agg(F.first("n_agree"))


def majority(notes: DataFrame, items: DataFrame | None = None, needed: int = 2) -> DataFrame:
    """(item_id, answerable, multi_hop, n_reviewers): flags that at least `needed` reviewers set; with items (item_id, ..) their other fields stay."""
    said = lambda c: (F.count_if(F.coalesce(c, F.lit(False))) >= needed).alias(c)
    voted = notes.groupBy("item_id").agg(said("answerable"), said("multi_hop"), F.count("*").alias("n_reviewers"))
    return voted if items is None else items.join(voted, "item_id")


def uneven_reviewers(notes: DataFrame) -> DataFrame:
    """(reviewer, n_items, reason) of reviewers that lack items which others have: a reject of the vote."""
    per = notes.groupBy("reviewer").agg(F.count_distinct("item_id").alias("n_items"))
    every = notes.agg(F.count_distinct("item_id").alias("n_all"))
    return per.join(every, F.col("n_items") < F.col("n_all")).select("reviewer", "n_items", F.lit("other number of items").alias("reason"))


def validity_counts(notes: DataFrame) -> DataFrame:
    """Per pair of reviewers (a < b), the items that both call answerable, both call multi-hop, and both call both."""
    a = notes.select("item_id", F.col("reviewer").alias("a"), F.coalesce("answerable", F.lit(False)).alias("x"), F.coalesce("multi_hop", F.lit(False)).alias("y"))
    b = a.select("item_id", F.col("a").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    joined = a.join(b, "item_id").filter("a < b")
    return joined.groupBy("a", "b").agg(F.count_if(F.expr("x and x2")).alias("answerable"), F.count_if(F.expr("y and y2")).alias("multi_hop"), F.count_if(F.expr("x and x2 and y and y2")).alias("valid"))


def plain_answer(text):
    """Answers for exact match: cut at the closing tag, lower case, punctuation deleted, single spaces; accents and articles stay."""
    cut = F.split_part(text, F.lit("</answer>"), F.lit(1))
    bare = F.regexp_replace(F.lower(cut), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def exact_match(records: DataFrame, *groups: str) -> DataFrame:
    """(groups, n, n_correct, accuracy) of records with completion and answer."""
    scored = records.withColumn("correct", plain_answer(F.col("completion")).eqNullSafe(plain_answer(F.col("answer"))))
    return scored.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))
