"""Feature sets over fused and placed lists, fixed floors, plain unions, samples that keep positives."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import features, fusion, ranking, splits
from lodestone.operators.candidates import row_rank
from lodestone.plans import mapping as m
from lodestone.plans import ranking_queries
from lodestone.plans.candidate_queries import PAIRS, RRF, SOURCES
from lodestone.plans.registry import query

ROUTES, DEPTH = 10, 30
FLOORS = {"A": -1.0, "N": -0.5}

_PLACED = ranking_queries.PLACED.replace("SELECT query_id, item_id, max(score) AS score FROM candidates GROUP BY ALL", f"SELECT query_id, item_id, rrf_score AS score, rank FROM ({RRF})")
_CONTEXT = f""", routes AS (SELECT query_id, microcat AS category, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, microcat) AS rank FROM truth JOIN items USING (item_id) GROUP BY query_id, microcat QUALIFY rank <= {ROUTES}),
 asked AS (SELECT s.query_id, i.title AS query_text, CAST(s.position % 2 AS INTEGER) AS q_delivery FROM suppliers s LEFT JOIN items i ON i.position = s.position),
 ctx AS (SELECT p.*, r.rank AS route_rank, a.query_text, a.q_delivery, i.text AS item_text FROM placed p JOIN items i ON i.item_id = p.item_id LEFT JOIN routes r ON r.query_id = p.query_id AND r.category = i.microcat JOIN asked a ON a.query_id = p.query_id)"""
_NEED = (*ranking_queries.NEED, "truth")
_NEAR, _SAME, _CATEGORY, _ANY = "coalesce(distance_km, 500.0)", "(CASE WHEN q_location = i_location THEN 1 ELSE 0 END)", "(CASE WHEN q_category = i_category THEN 1 ELSE 0 END)", "(CASE WHEN q_category = 0 THEN 1 ELSE 0 END)"


def _digits(df, digits):
    """Rounded columns; adding 0 makes minus nought nought."""
    return df.select(*((F.round(c, digits[c]) + 0.0).alias(c) if c in digits else c for c in df.columns))


def _context(spark, d):
    c, i, s, t = m.candidates(spark, d), m.items(spark, d), m.suppliers(spark, d), m.truth(spark, d)
    fused = fusion.reciprocal_rank_fusion(c).select("query_id", "item_id", F.col("rrf_score").alias("score"), "rank")
    placed = ranking.with_places(fused, s, i, ranking.location_centroids(i))
    counted = t.join(i, "item_id").groupBy("query_id", F.col("microcat").alias("category")).agg(F.count("*").alias("n"))
    routes = counted.withColumn("rank", row_rank(["query_id"], [F.desc("n"), F.asc("category")])).where(F.col("rank") <= ROUTES).drop("n")
    asked = s.join(i.select("position", F.col("title").alias("query_text")), "position", "left").select("query_id", "query_text", (F.col("position") % 2).cast("int").alias("q_delivery"))
    return c, placed, routes, asked, i.select("item_id", F.col("text").alias("item_text"), F.col("microcat").alias("i_route"))


def _list_columns(s):
    return f"coalesce(\"{s}_score\", 0.0) AS \"{s}_score\", round(1 / (coalesce(\"{s}_rank\", {DEPTH + 1}) + 1), 9) + 0.0 AS \"{s}_inverse_rank\", coalesce(\"{s}_present\", 0) AS \"in_{s}\""


_WORDS_A, _WORDS_B = (rf"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '\S+'))" for c in ("query_text", "item_text"))
_SHARED = f"len(list_intersect({_WORDS_A}, {_WORDS_B}))"
_ANALYTIC = _PLACED + _CONTEXT + f""", f AS ({PAIRS.replace("FROM candidates", f"FROM candidates WHERE rank <= {DEPTH}")}), n AS (SELECT *, max(score) OVER q AS best, avg(score) OVER q AS mean, stddev_pop(score) OVER q AS deviation FROM ctx WINDOW q AS (PARTITION BY query_id))
 SELECT query_id, item_id, rank, score, round(score / (best + 1e-6), 6) + 0.0 AS score_norm, round(best - score, 6) + 0.0 AS score_diff, round((score - mean) / (deviation + 1e-6), 5) + 0.0 AS score_z, round(1 / (rank + 1), 9) + 0.0 AS inverse_rank, round(ln(1 + rank), 7) + 0.0 AS log_rank,
 {", ".join(_list_columns(s) for s in SOURCES)}, {" + ".join(f'coalesce("{s}_present", 0)' for s in SOURCES)} AS source_count,
 CAST(coalesce(route_rank - 1, -1) AS INTEGER) AS route_rank, CASE WHEN route_rank = 1 THEN 1 ELSE 0 END AS first_route, CASE WHEN route_rank <= 3 THEN 1 ELSE 0 END AS early_route,
 {_SAME} AS same_location, round({_NEAR}, 5) + 0.0 AS distance_km, round(ln(1 + {_NEAR}), 7) + 0.0 AS log_distance, CASE WHEN distance_km IS NULL THEN 1 ELSE 0 END AS distance_missing,
 q_delivery, round(q_delivery * {_NEAR}, 5) + 0.0 AS delivery_distance, q_delivery * {_SAME} AS delivery_same, {_CATEGORY} AS same_category, {_ANY} AS any_category, greatest({_CATEGORY}, {_ANY}) AS valid_category,
 CAST({_SHARED} AS INTEGER) AS shared_words, round(coalesce({_SHARED} / nullif(len(list_distinct(list_concat({_WORDS_A}, {_WORDS_B}))), 0), 0.0), 9) + 0.0 AS word_jaccard, CAST(len({_WORDS_A}) AS INTEGER) AS query_words
 FROM n LEFT JOIN f USING (query_id, item_id)"""
_ANALYTIC_DIGITS = {"score_norm": 6, "score_diff": 6, "score_z": 5, "inverse_rank": 9, "log_rank": 7, "distance_km": 5, "log_distance": 7, "delivery_distance": 5, "word_jaccard": 9} | {f"{s}_inverse_rank": 9 for s in SOURCES}


@query("analytic_features", m.sql(_ANALYTIC, *_NEED))
def analytic_features(spark, d):
    c, placed, routes, asked, items = _context(spark, d)
    return _digits(features.analytic_features(placed, c, SOURCES, routes, asked, items, DEPTH), _ANALYTIC_DIGITS)


_TIER = "CASE WHEN q_location = i_location THEN 1 WHEN distance_km <= 50 THEN 2 WHEN distance_km IS NOT NULL THEN 3 ELSE 4 END"
_KM = f"CASE WHEN q_location = i_location THEN 0.0 ELSE {_NEAR} END"
_CASCADE = _PLACED + _CONTEXT + f""", c AS (SELECT *, round(score * {ranking_queries.CAT} * {ranking_queries.GEO}, 9) AS final, score / (max(score) OVER (PARTITION BY query_id) + 1e-6) AS fused_norm FROM ctx),
 n AS (SELECT *, max(final) OVER q AS best, avg(final) OVER q AS mean, coalesce(stddev_samp(final) OVER q, 1.0) AS deviation FROM c WINDOW q AS (PARTITION BY query_id))
 SELECT query_id, item_id, rank, score AS fused_score, round(fused_norm, 6) + 0.0 AS fused_norm, round(1 / (rank + 1), 9) + 0.0 AS inverse_rank, round(ln(1 + rank), 7) + 0.0 AS log_rank, {_TIER} AS geo_tier, {_SAME} AS same_location,
 round({_KM}, 5) + 0.0 AS distance_km, round(ln(1 + {_KM}), 7) + 0.0 AS log_distance, greatest({_CATEGORY}, {_ANY}) AS valid_category, q_delivery, CAST(coalesce(route_rank, -1) AS INTEGER) AS route_rank,
 final AS cascade_score, round(ln(1 + greatest(final, 0.0)), 7) + 0.0 AS log_cascade, round(final / (best + 1e-9), 6) + 0.0 AS cascade_norm, round(best - final, 9) + 0.0 AS cascade_diff, round((final - mean) / (deviation + 1e-9), 4) + 0.0 AS cascade_z FROM n"""
_CASCADE_DIGITS = {"fused_norm": 6, "inverse_rank": 9, "log_rank": 7, "distance_km": 5, "log_distance": 7, "log_cascade": 7, "cascade_norm": 6, "cascade_diff": 9, "cascade_z": 4}


@query("cascade_features", m.sql(_CASCADE, *_NEED))
def cascade_features(spark, d):
    _, placed, routes, asked, items = _context(spark, d)
    return _digits(features.cascade_features(placed, routes, asked, items), _CASCADE_DIGITS)


_FLOORED = ", ".join(f"coalesce(\"{s}_score\", {FLOORS.get(s, fusion.OTHER_FLOOR)}) AS \"{s}_score\", coalesce(\"{s}_rank\", 51) AS \"{s}_rank\", \"{s}_present\"" for s in SOURCES)


@query("features_fixed_floors", m.sql(f", f AS ({PAIRS}) SELECT query_id, item_id, {_FLOORED}, retriever_count FROM f", "candidates"))
def features_fixed_floors(spark, d):
    return fusion.filled_features(fusion.pair_features(m.candidates(spark, d), SOURCES), SOURCES, 50, FLOORS)


@query("rrf_union_plain", m.sql(", l AS (SELECT * FROM candidates UNION ALL SELECT * FROM candidates WHERE source = 'A'), s AS (SELECT query_id, item_id, round(sum(CASE source WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.25 END / (60 + rank)), 9) AS score FROM l GROUP BY query_id, item_id) SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s QUALIFY rank <= 50", "candidates"))
def rrf_union_plain(spark, d):
    """An item that a list repeats counts each time, by the places as they are."""
    c = m.candidates(spark, d)
    return fusion.weighted_rrf(c.unionByName(c.where("source = 'A'")), {"A": 1.0, "N": 0.5, "R": 0.25}, compress=False)


@query("sample_keeping_positives", m.sql(", kept AS (SELECT item_id FROM items WHERE item_id IN (SELECT item_id FROM truth)) SELECT (SELECT count(*) FROM kept) AS kept, least(100, (SELECT count(*) FROM items) - (SELECT count(*) FROM kept)) AS others, 0::BIGINT AS lost", "items", "truth"))
def sample_keeping_positives(spark, d):
    """How many items a sample keeps, and no positive that it loses."""
    i, t = m.items(spark, d), m.truth(spark, d).select("item_id").distinct()
    marked = splits.sample_keeping(i, t, 100).select("item_id").join(t.withColumn("p", F.lit(1)), "item_id", "left")
    lost = t.join(i, "item_id", "left_semi").join(marked.select("item_id"), "item_id", "left_anti").agg(F.count("*").alias("lost"))
    return marked.agg(F.count("p").alias("kept"), F.count_if(F.col("p").isNull()).alias("others")).crossJoin(lost)
