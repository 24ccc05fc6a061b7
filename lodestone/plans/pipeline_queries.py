"""Whole pipelines over the driver's tables; no single SQL says them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import dense
from lodestone.plans import champion, ranking_queries
from lodestone.plans import mapping as m
from lodestone.plans.candidate_queries import SOURCES
from lodestone.plans.registry import query


@query("champion_answer")
def champion_answer(spark, d):
    items = m.items(spark, d).withColumn("description", F.col("text"))
    queries = m.queries(spark, d).select("query_id", F.col("title").alias("search_query"), "params", "category", "location")
    vectors = dense.encode(items, "item_id", "title", dense.length_sum_encoder, 2), dense.encode(queries, "query_id", "search_query", dense.length_sum_encoder, 2)
    return champion.champion(m.train(spark, d), queries, items, vectors=vectors)


@query("selected_answer")
def selected_answer(spark, d):
    return champion.selected(m.candidates(spark, d), m.truth(spark, d), SOURCES).select("query_id", "item_id", "final_score", "rank")


_A, _B = (f"list_distinct(regexp_extract_all(lower({c}), '[0-9a-z]+'))" for c in ("item_title", "item_text"))
_NEAR, _SAME = "coalesce(distance_km, 500.0)", "(CASE WHEN q_location = i_location THEN 1 ELSE 0 END)"
_SHARED = f"len(list_intersect({_A}, {_B}))"
_FEATURES = ranking_queries.PLACED + f""", n AS (SELECT *, max(score) OVER q AS best, avg(score) OVER q AS mean, coalesce(stddev_pop(score) OVER q, 1.0) AS deviation, count(*) OVER q AS n_candidates, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM placed WINDOW q AS (PARTITION BY query_id))
 SELECT query_id, n.item_id, score, round(score / (best + 1e-6), 6) AS score_norm, round(best - score, 6) AS score_diff, round((score - mean) / (deviation + 1e-6), 5) AS score_z, n_candidates, round(1 / (r + 60), 9) AS inverse_rank, {ranking_queries.TIER} AS geo_tier, round({_NEAR}, 5) AS distance_km, round(exp(-0.25 * {_NEAR} / 10), 9) AS distance_decay,
 round(ln(1 + {_NEAR}), 7) AS log_distance, {_SAME} AS same_location, CASE WHEN q_category = i_category THEN 1 ELSE 0 END AS same_category, CASE WHEN q_category = 0 THEN 1 ELSE 0 END AS any_category, 1 AS q_delivery, round({_NEAR}, 5) AS delivery_distance, {_SAME} AS delivery_same, len({_A})::INTEGER AS query_words, len({_B})::INTEGER AS item_words,
 {_SHARED}::INTEGER AS shared_words, round({_SHARED} / len({_A}), 9) AS word_recall, round({_SHARED} / len(list_distinct(list_concat({_A}, {_B}))), 9) AS word_jaccard
 FROM n JOIN (SELECT item_id, title AS item_title, text AS item_text FROM items) t ON t.item_id = n.item_id"""
_DIGITS = {"score_norm": 6, "score_diff": 6, "score_z": 5, "inverse_rank": 9, "distance_km": 5, "distance_decay": 9, "log_distance": 7, "delivery_distance": 5, "word_recall": 9, "word_jaccard": 9}


@query("ranker_features", m.sql(_FEATURES, *ranking_queries.NEED))
def ranker_features(spark, d):
    """All columns of a ranker."""
    placed = ranking_queries.placed(spark, d)
    texts = placed.select("query_id", "item_id").join(m.items(spark, d).select("item_id", F.col("title").alias("query_text"), F.col("text").alias("item_text")), "item_id").withColumn("q_delivery", F.lit(1))
    f = champion.ranker_features(placed, texts)
    return f.select(*(F.round(c, _DIGITS[c]).alias(c) if c in _DIGITS else c for c in f.columns))
