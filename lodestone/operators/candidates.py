"""The candidate relation (query_id, item_id, source, score, rank): ranking, dedup, union, padding.

Ties go to the smaller item_id. row_number() <= k lets Spark keep k rows of each group before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("query_id", "item_id", "source", "score", "rank")


def row_rank(partition: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def top_k(scored: DataFrame, k: int, score: str = "score", by: tuple[str, ...] = ("query_id",), second: str | None = None) -> DataFrame:
    """The k best of each group with their rank; `second` breaks ties before the id does."""
    order = [F.desc_nulls_last(score), *([F.desc_nulls_last(second)] if second else []), F.asc("item_id")]
    return scored.withColumn("rank", row_rank(list(by), order)).where(F.col("rank") <= k)


def distinct_best(scored: DataFrame, score: str = "score", by: tuple[str, ...] = ("query_id", "item_id")) -> DataFrame:
    """One row for each pair, that of the best score; equal scores by source."""
    others = [F.asc(c) for c in ("source", "rank") if c in scored.columns and c not in by]
    return scored.withColumn("__r", row_rank(list(by), [F.desc_nulls_last(score), *others])).where("__r = 1").drop("__r")


def rank_candidates(scored: DataFrame, score: str = "score", limit: int = 50) -> DataFrame:
    """Dedup by pair, then the best `limit` of each query."""
    return top_k(distinct_best(scored.drop("rank"), score), limit, score)


def rank_predictions(scored: DataFrame, limit: int = 50) -> DataFrame:
    """final_score, then rrf_score (missing is 0), then id."""
    return top_k(scored.withColumn("rrf_score", F.coalesce("rrf_score", F.lit(0.0))), limit, "final_score", second="rrf_score")


def union(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def top_k_pairs(candidates: DataFrame, k: int, by_source: bool = True) -> DataFrame:
    """Distinct (query_id, item_id) among each source's best k."""
    return candidates.where(F.col("rank") <= k).select("query_id", "item_id", *(["source"] if by_source else [])).distinct()


def union_best(candidates: DataFrame, limit: int) -> DataFrame:
    """Sources merged on raw scores: each pair's best, then the best `limit`."""
    best = candidates.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return top_k(best, limit)


def pad_to_k(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, eligible: DataFrame | None = None) -> DataFrame:
    """Each query's rows filled up to k with score 0, by ascending item_id, with items that it hasn't.

    A query with h rows needs at most the k smallest of the items it may have: the h it has can't hide more than h of
    them. So the supply is k rows (of the corpus, or of each query's `eligible` items), never the corpus.
    """
    if eligible is None:
        supply = queries.select("query_id").crossJoin(F.broadcast(corpus.select("item_id").distinct().orderBy("item_id").limit(k)))
    else:
        supply = eligible.select("query_id", "item_id").distinct().withColumn("__p", row_rank(["query_id"], [F.asc("item_id")])).where(F.col("__p") <= k).drop("__p")
    pads = supply.join(ranked.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti").withColumn("score", F.lit(0.0))
    rows = ranked.select("query_id", "item_id", "score", F.lit(0).alias("__block")).unionByName(pads.withColumn("__block", F.lit(1)))
    return rows.withColumn("rank", row_rank(["query_id"], [F.asc("__block"), F.desc("score"), F.asc("item_id")])).where(F.col("rank") <= k).drop("__block")


def normalized_scores(candidates: DataFrame, population: bool = False, eps: float = 1e-9) -> DataFrame:
    """Per query: share of the best, distance from it and z-score (of one row: deviation 1)."""
    w = Window.partitionBy("query_id")
    deviation = F.coalesce((F.stddev_pop if population else F.stddev_samp)("score").over(w), F.lit(1.0))
    best = F.max("score").over(w)
    return candidates.withColumns({"score_norm": F.col("score") / (best + eps), "score_diff": best - F.col("score"), "score_z": (F.col("score") - F.avg("score").over(w)) / (deviation + eps), "n_candidates": F.count("*").over(w)})


def hard_negatives(candidates: DataFrame, positives: DataFrame, max_per_query: int = 20) -> DataFrame:
    """Candidates that aren't positives, first of each pair by source and rank, at most so many a query."""
    negatives = candidates.join(positives.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    first = negatives.withColumn("__r", row_rank(["query_id", "item_id"], [F.asc("source"), F.asc("rank")])).where("__r = 1").drop("__r")
    return first.withColumn("sampling_order", row_rank(["query_id"], [F.asc("source"), F.asc("rank"), F.asc("item_id")])).where(F.col("sampling_order") <= max_per_query)
