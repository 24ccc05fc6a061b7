"""Interactions, ground truth, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.ids import hash_bucket, hash_number, hash_split
from lodestone.operators.contracts import SchemaError


def distinct_interactions(train: DataFrame) -> DataFrame:
    return train.select("query_id", "item_id").distinct().withColumn("label", F.lit(1))


def dedup_items(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """One snapshot of each item: the least by all other columns in the order of their names, nulls last."""
    others = sorted(c for c in rows.columns if c != key)
    order = Window.partitionBy(key).orderBy(*(F.asc_nulls_last(c) for c in others))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def item_splits(items: DataFrame, seed: int = 42, proportions: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    return items.select("item_id", hash_split(F.concat(F.lit(f"{seed}:"), "item_id"), proportions).alias("split"))


def ground_truth(interactions: DataFrame, splits: DataFrame, strict: bool = True) -> DataFrame:
    """split, query_id, item_id; an interaction whose item has no split is an error."""
    joined = interactions.select("query_id", "item_id").distinct().join(splits, "item_id", "left")
    if strict and not joined.where("split is null").isEmpty():
        raise SchemaError("interactions with items that have no split")
    return joined.select("split", "query_id", "item_id")


def query_slices(truth: DataFrame) -> DataFrame:
    return truth.groupBy("split", "query_id").agg(F.count_distinct("item_id").alias("relevant_count")).withColumn("is_multi_positive", F.col("relevant_count") > 1)


def context_folds(contexts: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    return contexts.select("query_id").distinct().withColumn("fold", hash_bucket(F.concat(F.lit(f"{seed}:"), "query_id"), folds))


def context_holdout(train: DataFrame, corpus: DataFrame, train_fold: int = 0, folds: int = 5, seed: int = 42, single_fold: bool = True) -> DataFrame:
    """query_id, item_id, part, fold, known_positives, of interactions with items of the corpus.

    single_fold: only train_fold trains, as in the research split; else it is held out and the others train.
    """
    pairs = train.select("query_id", "item_id").distinct().join(corpus.select("item_id").distinct(), "item_id", "left_semi")
    marked = pairs.withColumn("fold", hash_bucket(F.concat(F.lit(f"{seed}:"), "query_id"), folds))
    trains = (F.col("fold") == train_fold) if single_fold else (F.col("fold") != train_fold)
    return marked.withColumn("part", F.when(trains, "train").otherwise("validation")).withColumn("known_positives", F.count("*").over(Window.partitionBy("query_id")))


def strict_unseen(train: DataFrame, text: str = "text", folds: int = 5, seed: int = 42) -> DataFrame:
    """Interactions by whether their normalised query text is held out; a text is on one side only."""
    return train.withColumn("part", F.when(hash_bucket(F.concat(F.lit(f"{seed}:"), tx.normalize(text)), folds) == 0, "unseen").otherwise("seen"))


def stratified_sample(rows: DataFrame, strata: Sequence[str], per_stratum: int, seed: int = 42, key: str = "query_id") -> DataFrame:
    """The first of each stratum in the order of a hash."""
    order = Window.partitionBy(*strata).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), key)
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_stratum).drop("__r")


def sample_keeping(items: DataFrame, positives: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All items with a positive, and the n others first in the order of a hash."""
    kept = items.join(positives.select("item_id").distinct(), "item_id", "left_semi")
    others = items.join(positives.select("item_id").distinct(), "item_id", "left_anti").orderBy(hash_number(F.concat(F.lit(f"{seed}:"), "item_id")), "item_id").limit(n)
    return kept.unionByName(others)
