"""Re-ranking by place and category, tiers, gating, and lists of an exact length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numeric import haversine_km
from lodestone.functions.numeric import score as rounded
from lodestone.operators.candidates import row_rank, top_k

#: Fixed values of the cascade.
SAME_PLACE, DECAY, NO_PLACE, OTHER_CATEGORY = 30.0, 0.25, 0.05, 0.001


def location_centroids(rows: DataFrame) -> DataFrame:
    """location, lat, lon: means of the rows that have both."""
    return rows.where("lat is not null and lon is not null").groupBy("location").agg(rounded(F.avg("lat")).alias("lat"), rounded(F.avg("lon")).alias("lon"))


def with_places(candidates: DataFrame, queries: DataFrame, items: DataFrame, centroids: DataFrame) -> DataFrame:
    """Candidates with q_category, q_location, q_lat, q_lon, i_category, i_location, i_lat, i_lon and distance_km (null if a place is missing)."""
    q = queries.join(centroids.select("location", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")), "location", "left")
    q = q.select("query_id", F.col("category").alias("q_category"), F.col("location").alias("q_location"), "q_lat", "q_lon")
    i = items.select("item_id", F.col("category").alias("i_category"), F.col("location").alias("i_location"), F.col("lat").alias("i_lat"), F.col("lon").alias("i_lon"))
    joined = candidates.join(q, "query_id").join(i, "item_id", "left")
    known = F.col("q_lat").isNotNull() & (F.coalesce("i_lat", F.lit(0.0)) != 0) & (F.coalesce("i_lon", F.lit(0.0)) != 0)
    return joined.withColumn("distance_km", F.when(known, haversine_km(F.col("q_lat"), F.col("q_lon"), F.col("i_lat"), F.col("i_lon"))))


def category_factor(wildcard: int | None = 0) -> Column:
    """1 for the query's category, or where the query's is the wildcard; else nearly nothing."""
    fits = F.col("q_category") == F.col("i_category")
    if wildcard is not None:
        fits = fits | (F.col("q_category") == wildcard)
    return F.when(F.coalesce(fits, F.lit(False)), F.lit(1.0)).otherwise(F.lit(OTHER_CATEGORY))


def place_factor(same: float = SAME_PLACE, decay: float = DECAY, missing: float = NO_PLACE) -> Column:
    same_place = F.coalesce(F.col("q_location") == F.col("i_location"), F.lit(False))
    return F.when(same_place, F.lit(same)).when(F.col("distance_km").isNotNull(), F.exp(-decay * F.col("distance_km") / 10)).otherwise(F.lit(missing))


def geo_cascade(placed: DataFrame, limit: int = 50, wildcard: int | None = 0, same: float = SAME_PLACE, decay: float = DECAY, missing: float = NO_PLACE) -> DataFrame:
    """score * category * place; the best `limit`."""
    return top_k(placed.withColumn("final_score", rounded(F.col("score") * category_factor(wildcard) * place_factor(same, decay, missing))), limit, "final_score")


def tier(near_km: float = 50.0) -> Column:
    """1 same place, 2 near, 3 farther or unknown, 4 another category."""
    return F.when(category_factor() < 1, 4).when(F.coalesce(F.col("q_location") == F.col("i_location"), F.lit(False)), 1).when(F.coalesce(F.col("distance_km") <= near_km, F.lit(False)), 2).otherwise(3)


def tiered_cascade(placed: DataFrame, local_cap: int = 40, limit: int = 50) -> DataFrame:
    """Local items first, at most local_cap of them, then near, then far, then other categories."""
    d = F.col("distance_km")
    value = F.when(F.col("tier") == 1, F.col("score")).when(F.col("tier") == 2, F.col("score") * F.exp(-0.02 * d)).when(F.col("tier") == 3, F.col("score") * F.coalesce(F.exp(-0.05 * d), F.lit(0.1))).otherwise(F.col("score") * OTHER_CATEGORY)
    tiers = placed.withColumn("tier", tier()).withColumn("tier_score", rounded(value))
    order = [F.desc("tier_score"), F.asc("item_id")]
    capped = tiers.withColumn("tier_rank", row_rank(["query_id", "tier"], order)).where((F.col("tier") > 1) | (F.col("tier_rank") <= local_cap))
    return capped.withColumn("rank", row_rank(["query_id"], [F.asc("tier"), *order])).where(F.col("rank") <= limit)


def semantic_gating(placed: DataFrame, share: float = 0.5, limit: int = 50) -> DataFrame:
    """The place counts only for candidates over a percentile of their query's scores."""
    edges = placed.groupBy("query_id").agg(F.percentile("score", F.lit(share)).alias("edge"))
    place = F.when(F.col("score") < F.col("edge"), F.lit(1.0)).otherwise(place_factor())
    return top_k(placed.join(edges, "query_id").withColumn("final_score", rounded(F.col("score") * category_factor() * place)), limit, "final_score")


def location_category_boost(placed: DataFrame, boost: float = 5.0, other: float = 0.01, limit: int = 50) -> DataFrame:
    here = F.coalesce(F.col("q_location") == F.col("i_location"), F.lit(False))
    factor = F.when(here, F.lit(boost)).otherwise(F.lit(1.0)) * F.when(category_factor() < 1, F.lit(other)).otherwise(F.lit(1.0))
    return top_k(placed.withColumn("final_score", rounded(F.col("score") * factor)), limit, "final_score")


def rank_in_tiers(placed: DataFrame, ranker: str, limit: int = 50, blend: float | None = None) -> DataFrame:
    """(5 - tier) * 100 + ranker score; or, blended, ln(1 + cascade) + blend * the ranker's z-score."""
    if blend is None:
        value = (5 - tier()) * 100 + F.col(ranker)
    else:
        w = Window.partitionBy("query_id")
        z = (F.col(ranker) - F.avg(ranker).over(w)) / (F.coalesce(F.stddev_samp(ranker).over(w), F.lit(1.0)) + 1e-9)
        value = F.log1p(F.col("score") * category_factor() * place_factor()) + blend * z
    return top_k(placed.withColumn("final_score", rounded(value)), limit, "final_score")


def fill_exactly(ranked: DataFrame, queries: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """Every query's list at exactly n: its own by rank, then items of the corpus in the order of `position` that it lacks."""
    supply = F.broadcast(corpus.select("item_id", "position").orderBy("position", "item_id").limit(2 * n))
    have = ranked.where(F.col("rank") <= n).select("query_id", "item_id", "rank")
    pads = queries.select("query_id").crossJoin(supply).join(have, ["query_id", "item_id"], "left_anti")
    rows = have.select("query_id", "item_id", F.lit(0).alias("b"), F.col("rank").cast("long").alias("p")).unionByName(pads.select("query_id", "item_id", F.lit(1).alias("b"), F.col("position").cast("long").alias("p")))
    return rows.withColumn("rank", row_rank(["query_id"], [F.asc("b"), F.asc("p"), F.asc("item_id")])).where(F.col("rank") <= n).select("query_id", "item_id", "rank")
