"""Rank fusion and pair features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numeric import score as rounded
from lodestone.operators.candidates import row_rank, top_k

RRF_C = 60
#: The score of a missing pair in a source that has no floor of its own. Fixed value.
OTHER_FLOOR = -100.0


def reciprocal_rank_fusion(candidates: DataFrame, c: int = RRF_C, limit: int = 50) -> DataFrame:
    """Sum of 1 / (c + rank) over sources; ranks as they are given."""
    fused = candidates.groupBy("query_id", "item_id").agg(rounded(F.sum(1.0 / (c + F.col("rank")))).alias("rrf_score"), F.count_distinct("source").alias("retriever_count"))
    return top_k(fused, limit, "rrf_score")


def weight_of(weights: Mapping[str, float], source: Column) -> Column:
    return F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))[source]


def compressed_ranks(candidates: DataFrame) -> DataFrame:
    """In each source an item's first place counts, and places are numbered anew."""
    first = candidates.groupBy("query_id", "source", "item_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", row_rank(["query_id", "source"], [F.asc("rank"), F.asc("item_id")]))


def weighted_rrf(candidates: DataFrame, weights: Mapping[str, float], c: int = RRF_C, limit: int = 50, compress: bool = True) -> DataFrame:
    """Sum of weight / (c + place). A source of weight 0 still brings its items in."""
    ranked = compressed_ranks(candidates) if compress else candidates
    part = weight_of(weights, F.col("source")) / (c + F.col("rank"))
    return top_k(ranked.groupBy("query_id", "item_id").agg(rounded(F.sum(part)).alias("score")), limit)


def weighted_rrf_grid(candidates: DataFrame, grid: DataFrame, limit: int = 50) -> DataFrame:
    """All settings (config, c, source, weight) at once; the grid is small and fixed."""
    ranked = compressed_ranks(candidates)
    parts = ranked.join(F.broadcast(grid), "source").groupBy("config", "query_id", "item_id").agg(rounded(F.sum(F.col("weight") / (F.col("c") + F.col("rank")))).alias("score"))
    return top_k(parts, limit, by=("config", "query_id"))


def pair_features(candidates: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Each pair's score, rank and presence by source, in one aggregation instead of a chain of outer joins."""
    aggs = []
    for s in sources:
        mine = F.col("source") == s
        aggs += [F.max(F.when(mine, F.col("score"))).alias(f"{s}_score"), F.min(F.when(mine, F.col("rank"))).alias(f"{s}_rank"), F.max(F.when(mine, 1).otherwise(0)).alias(f"{s}_present")]
    return candidates.groupBy("query_id", "item_id").agg(*aggs, F.count_distinct("source").cast("int").alias("retriever_count"))


def filled_features(features: DataFrame, sources: Sequence[str], k: int, floors: Mapping[str, float] | None = None) -> DataFrame:
    """Missing ranks are k + 1, missing scores one below the least of the whole table, or the floor given for their source (OTHER_FLOOR where it has none)."""
    if floors is not None:
        fixed = {f"{s}_score": F.coalesce(f"{s}_score", F.lit(float(floors.get(s, OTHER_FLOOR)))) for s in sources} | {f"{s}_rank": F.coalesce(f"{s}_rank", F.lit(k + 1)) for s in sources}
        return features.withColumns(fixed)
    floors = features.agg(*(F.coalesce(F.min(f"{s}_score") - 1, F.lit(-1.0)).alias(f"__f_{s}") for s in sources))
    filled = features.crossJoin(F.broadcast(floors))
    out = {f"{s}_score": F.coalesce(f"{s}_score", f"__f_{s}") for s in sources} | {f"{s}_rank": F.coalesce(F.col(f"{s}_rank"), F.lit(k + 1)) for s in sources}
    return filled.withColumns(out).drop(*(f"__f_{s}" for s in sources))


def labelled(features: DataFrame, truth: DataFrame, fold: int | None = None) -> DataFrame:
    """Features with label 1 for pairs of the ground truth, else 0."""
    out = features.join(truth.select("query_id", "item_id", F.lit(1).alias("label")), ["query_id", "item_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return out if fold is None else out.withColumn("fold", F.lit(fold))
