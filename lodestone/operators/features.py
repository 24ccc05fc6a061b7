"""Features of a ranked list for analysis and for rankers: scores within the query, lists, routes, places, delivery, words.

A place or category that is missing on either side counts as another one; null texts have no words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.numeric import score as rounded
from lodestone.operators import fusion, ranking
from lodestone.operators.candidates import normalized_scores

#: The distance of places that aren't known, and the place of a route that wasn't predicted. Fixed values.
FAR_KM, NO_ROUTE = 500.0, -1


def blank_words(c: Column | str) -> Column:
    """The distinct lower-cased words between blanks."""
    words = F.split(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def _with_routes(placed: DataFrame, items: DataFrame, routes: DataFrame) -> DataFrame:
    """placed with what `items` adds, and route_rank, 1 for the first route predicted, null for none."""
    predicted = routes.groupBy("query_id", F.col("category").alias("i_route")).agg(F.min("rank").alias("route_rank"))
    return placed.join(items, "item_id", "left").join(predicted, ["query_id", "i_route"], "left")


def analytic_features(placed: DataFrame, branches: DataFrame, sources: Sequence[str], routes: DataFrame, queries: DataFrame, items: DataFrame, depth: int = 1000) -> DataFrame:
    """Every feature of a fused list's pairs, one projection over one row a pair.

    placed: the fused list (score, rank) with places (`ranking.with_places`); branches: the lists it was fused from;
    routes: query_id, category, rank; queries: query_id, query_text, q_delivery; items: item_id, item_text, i_route.
    A list that lacks the pair, or has it beyond `depth`, gives score 0 and rank depth + 1.
    """
    held = fusion.pair_features(branches.where(F.col("source").isin(*sources) & (F.col("rank") <= depth)), sources).drop("retriever_count")
    rows = _with_routes(normalized_scores(placed, population=True, eps=1e-6), items, routes)
    rows = rows.join(queries, "query_id", "left").join(held, ["query_id", "item_id"], "left")
    near, route = F.coalesce("distance_km", F.lit(FAR_KM)), F.coalesce(F.col("route_rank") - 1, F.lit(NO_ROUTE))
    same, category, anything = _flag(F.col("q_location") == F.col("i_location")), _flag(F.col("q_category") == F.col("i_category")), _flag(F.col("q_category") == 0)
    delivery = F.coalesce(F.col("q_delivery").cast("int"), F.lit(0))
    asked, found = blank_words("query_text"), blank_words("item_text")
    here = {s: F.coalesce(f"{s}_present", F.lit(0)) for s in sources}
    lists = [c for s in sources for c in (
        F.coalesce(f"{s}_score", F.lit(0.0)).alias(f"{s}_score"), (1 / (F.coalesce(f"{s}_rank", F.lit(depth + 1)) + 1)).alias(f"{s}_inverse_rank"), here[s].alias(f"in_{s}"))]
    return rows.select(
        "query_id", "item_id", "rank", "score", "score_norm", "score_diff", "score_z", (1 / (F.col("rank") + 1)).alias("inverse_rank"), F.log1p("rank").alias("log_rank"),
        *lists, sum(here.values(), F.lit(0)).alias("source_count"),
        route.alias("route_rank"), (route == 0).cast("int").alias("first_route"), route.between(0, 2).cast("int").alias("early_route"),
        same.alias("same_location"), near.alias("distance_km"), F.log1p(near).alias("log_distance"), F.col("distance_km").isNull().cast("int").alias("distance_missing"),
        delivery.alias("q_delivery"), (delivery * near).alias("delivery_distance"), (delivery * same).alias("delivery_same"),
        category.alias("same_category"), anything.alias("any_category"), F.greatest(category, anything).alias("valid_category"),
        F.size(F.array_intersect(asked, found)).alias("shared_words"), F.coalesce(tx.jaccard(asked, found), F.lit(0.0)).alias("word_jaccard"), F.size(asked).alias("query_words"))


def cascade_features(placed: DataFrame, routes: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """What a ranker after the geo-cascade reads: the fused list's place and score, the place's tier, and the cascade's score within the query.

    placed, routes, queries and items as for `analytic_features`; texts aren't read.
    """
    cascade = rounded(F.col("score") * ranking.category_factor() * ranking.place_factor())
    best = normalized_scores(placed, eps=1e-6).select(*placed.columns, F.col("score_norm").alias("fused_norm"), F.col("score").alias("fused_score"))
    scored = normalized_scores(best.withColumn("score", cascade))
    rows = _with_routes(scored, items.select("item_id", "i_route"), routes).join(queries.select("query_id", "q_delivery"), "query_id", "left")
    here = F.coalesce(F.col("q_location") == F.col("i_location"), F.lit(False))
    near = F.when(here, 0.0).otherwise(F.coalesce("distance_km", F.lit(FAR_KM)))
    tier = F.when(here, 1).when(F.col("distance_km") <= 50.0, 2).when(F.col("distance_km").isNotNull(), 3).otherwise(4)
    return rows.select(
        "query_id", "item_id", "rank", "fused_score", "fused_norm", (1 / (F.col("rank") + 1)).alias("inverse_rank"), F.log1p("rank").alias("log_rank"), tier.alias("geo_tier"), here.cast("int").alias("same_location"),
        near.alias("distance_km"), F.log1p(near).alias("log_distance"), (ranking.category_factor() == 1).cast("int").alias("valid_category"), F.coalesce(F.col("q_delivery").cast("int"), F.lit(0)).alias("q_delivery"),
        F.coalesce("route_rank", F.lit(NO_ROUTE)).alias("route_rank"), F.col("score").alias("cascade_score"), F.log1p(F.greatest("score", F.lit(0.0))).alias("log_cascade"),
        F.col("score_norm").alias("cascade_norm"), F.col("score_diff").alias("cascade_diff"), F.col("score_z").alias("cascade_z"))
