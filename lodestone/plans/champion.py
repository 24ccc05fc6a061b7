"""Whole pipelines: the routed champion (routes, seven lists, weighted fusion, geo-cascade, exact lists) and the selected one."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import candidates as cand
from lodestone.operators import dense, fusion, lexical, ml, ranking, routing
from lodestone.operators.settle import settled, staged

#: Weights of the champion's lists. Fixed values.
WEIGHTS = {"word": 1.5, "char": 1.2, "title_params": 0.8, "dense": 0.5, "word_all": 0.4, "char_all": 0.3, "dense_all": 0.3}


@dataclass(frozen=True)
class Depths:
    routes: int = 10
    routed: int = 1000
    everywhere: int = 300
    fused: int = 1000
    answer: int = 50
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))


def routes_for(train: DataFrame, queries: DataFrame, k: int, classifier: bool = True) -> DataFrame:
    """query_id, route: the query text's own categories, or the classifier's for texts that weren't seen, or the prior."""
    history = train.select(tx.normalize("search_query").alias("query"), F.col("microcat").cast("string").alias("category"))
    asked = queries.select("query_id", tx.normalize("search_query").alias("query"))
    if not classifier:
        return routing.posterior_top_k(history, asked, k).select("query_id", F.col("category").alias("route"))
    known = routing.support(history, asked)
    new = asked.join(known.where(~F.col("is_seen")), "query_id", "left_semi").select("query_id", F.col("query").alias("text"))
    guessed = routing.classifier_routes(history.where("query is not null and category is not null").select(F.col("query").alias("text"), "category"), new, k)
    return routing.hybrid(history, asked, guessed, k, min_count=1).select("query_id", F.col("category").alias("route"))


def lists(queries: DataFrame, items: DataFrame, routes: DataFrame, d: Depths, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The candidate relation of all lists. vectors: (item_id, embedding), (query_id, embedding).

    queries: query_id, search_query, params. items: item_id, route, title, params, description.
    """
    q = queries.select("query_id", tx.normalize("search_query").alias("text"), tx.compose(tx.normalize("search_query"), tx.normalize("params")).alias("long"))
    i = items.select("item_id", "route", tx.normalize("title").alias("title"), F.concat_ws(" ", tx.normalize("title"), tx.normalize("params")).alias("title_params"))
    columns = ("query_id", "item_id", "source", "score", "rank")
    out = []

    def add(name: str, ranked: DataFrame) -> None:
        out.append(ranked.withColumn("source", F.lit(name)).select(*columns))

    for name, text, asked, analyzer in (("word", "title", "text", lexical.word_12), ("char", "title", "text", lexical.char_wb_35), ("title_params", "title_params", "long", lexical.char_wb_35)):
        held, wanted = i.select("item_id", "route", F.col(text).alias("text")), q.select("query_id", F.col(asked).alias("text"))
        add(name, lexical.tfidf_routed(held, wanted, routes, d.routed, analyzer))
        if name != "title_params":
            add(f"{name}_all", lexical.tfidf(held, wanted, d.everywhere, analyzer))
    if vectors is not None:
        held, asked = vectors
        held = held.join(items.select("item_id", "route"), "item_id")
        add("dense", dense.routed_top_k(held, asked, routes, d.routed))
        add("dense_all", dense.exact_top_k(held, asked, d.everywhere))
    return cand.union(*out)


def champion(train: DataFrame, queries: DataFrame, items: DataFrame, d: Depths | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, classifier: bool = True) -> DataFrame:
    """query_id, item_id, rank: every query's `answer` items.

    train: search_query, microcat. queries: query_id, search_query, params, category, location. items: item_id, title,
    params, description, microcat, category, location, lat, lon, position. Without vectors the dense lists are left out.
    """
    d = d or Depths()
    held = items.withColumn("route", F.col("microcat").cast("string"))
    routes = settled(routes_for(train, queries, d.routes, classifier))
    found = lists(queries, held, routes, d, vectors)
    fused = settled(fusion.weighted_rrf(found, d.weights, limit=d.fused).drop("rank"))
    placed = ranking.with_places(fused, queries, items, ranking.location_centroids(items))
    ranked = settled(ranking.geo_cascade(placed, d.answer))
    return ranking.fill_exactly(ranked.select("query_id", "item_id", "rank"), queries, items, d.answer)


def selected(candidates: DataFrame, truth: DataFrame, sources: tuple[str, ...], depth: int = 500, limit: int = 50, folds: int = 5) -> DataFrame:
    """The learned pipeline: features over the union of all lists, and for each fold of the queries the ranking of a selector tuned on the others."""
    from lodestone.functions.ids import hash_bucket

    pairs = staged(fusion.pair_features(candidates.where(F.col("rank") <= depth), sources))
    table = fusion.labelled(fusion.filled_features(pairs, sources, depth), truth)
    marked = staged(table.withColumn("part", hash_bucket(F.concat(F.lit("selector:"), "query_id"), folds)), "part")
    names, out = ml.feature_columns(table), None
    for n in range(folds):
        model = ml.train_selector(marked.where(F.col("part") != n).drop("part"), names)
        one = ml.rank_with_selector(model, marked.where(F.col("part") == n).drop("part"), limit)
        out = one if out is None else out.unionByName(one)
    return out


def ranker_features(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Columns for a ranker over placed candidates: scores within the query, place, category, delivery and shared words.

    texts: query_id, item_id, query_text, item_text, q_delivery.
    """
    n = cand.normalized_scores(placed, population=True, eps=1e-6).withColumn("place_in_list", cand.row_rank(["query_id"], [F.desc("score"), F.asc("item_id")]))
    a, b = tx.token_set("query_text"), tx.token_set("item_text")
    near = F.coalesce(F.col("distance_km"), F.lit(500.0))
    same = F.coalesce(F.col("q_location") == F.col("i_location"), F.lit(False)).cast("int")
    return n.join(texts, ["query_id", "item_id"]).select(
        "query_id", "item_id", "score", "score_norm", "score_diff", "score_z", "n_candidates", (1 / (F.col("place_in_list") + 60)).alias("inverse_rank"), ranking.tier().alias("geo_tier"), near.alias("distance_km"),
        F.exp(-0.25 * near / 10).alias("distance_decay"), F.log1p(near).alias("log_distance"), same.alias("same_location"), F.coalesce(F.col("q_category") == F.col("i_category"), F.lit(False)).cast("int").alias("same_category"),
        (F.col("q_category") == 0).cast("int").alias("any_category"), "q_delivery", (F.col("q_delivery") * near).alias("delivery_distance"), (F.col("q_delivery") * same).alias("delivery_same"),
        F.size(a).alias("query_words"), F.size(b).alias("item_words"), F.size(F.array_intersect(a, b)).alias("shared_words"), F.coalesce(tx.token_recall(a, b), F.lit(0.0)).alias("word_recall"), tx.jaccard(a, b).alias("word_jaccard"))
