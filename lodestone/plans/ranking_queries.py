"""Places, tiers, exact lists, submissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import contracts, fusion, ranking
from lodestone.plans import mapping as m
from lodestone.plans.candidate_queries import RRF
from lodestone.plans.registry import query
from lodestone.sources.tables import answer_rows

CENTROIDS = "SELECT location, round(avg(lat), 9) AS lat, round(avg(lon), 9) AS lon FROM items WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY location"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(i.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(i.lat)) * pow(sin(radians(i.lon - c.lon) / 2), 2)))))"
PLACED = f""", u AS (SELECT query_id, item_id, max(score) AS score FROM candidates GROUP BY ALL), cen AS ({CENTROIDS}), placed AS (SELECT u.*, s.category AS q_category, s.location AS q_location, i.category AS i_category, i.location AS i_location,
 CASE WHEN c.lat IS NOT NULL AND i.lat <> 0 AND i.lon <> 0 THEN {_KM} END AS distance_km FROM u JOIN suppliers s USING (query_id) LEFT JOIN cen c ON c.location = s.location LEFT JOIN items i ON i.item_id = u.item_id)"""
_CAT = "CASE WHEN q_category = i_category {w} THEN 1.0 ELSE 0.001 END"
CAT = _CAT.format(w="OR q_category = 0")
GEO = "CASE WHEN q_location = i_location THEN 30.0 WHEN distance_km IS NOT NULL THEN exp(-0.25 * distance_km / 10) ELSE 0.05 END"
TIER = f"CASE WHEN {CAT} < 1 THEN 4 WHEN q_location = i_location THEN 1 WHEN distance_km <= 50 THEN 2 ELSE 3 END"
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, item_id)"
NEED = ("candidates", "suppliers", "items")


def placed(spark, d):
    u = m.candidates(spark, d).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    i = m.items(spark, d)
    return ranking.with_places(u, m.suppliers(spark, d), i, ranking.location_centroids(i))


def _final(value):
    return m.sql(PLACED + f" SELECT query_id, item_id, final_score, {_TOP} AS rank FROM (SELECT query_id, item_id, round({value}, 9) AS final_score FROM placed) QUALIFY rank <= 50", *NEED)


def _shown(df):
    return df.select("query_id", "item_id", "final_score", "rank")


@query("location_centroids", m.sql(CENTROIDS, "items"))
def location_centroids(spark, d):
    return ranking.location_centroids(m.items(spark, d))


@query("geo_cascade_wildcard", _final(f"score * {CAT} * {GEO}"))
def geo_cascade_wildcard(spark, d):
    return _shown(ranking.geo_cascade(placed(spark, d)))


@query("geo_cascade_top50", _final(f"score * {_CAT.format(w='')} * {GEO}"))
def geo_cascade_top50(spark, d):
    return _shown(ranking.geo_cascade(placed(spark, d), wildcard=None))


@query("geo_cascade_missing_tenth", _final(f"score * {CAT} * {GEO.replace('0.05', '0.1').replace('30.0', '10.0').replace('0.25', '0.2')}"))
def geo_cascade_missing_tenth(spark, d):
    return _shown(ranking.geo_cascade(placed(spark, d), same=10.0, decay=0.2, missing=0.1))


@query("geo_tiers", m.sql(PLACED + f" SELECT tier, count(*) AS n FROM (SELECT {TIER} AS tier FROM placed) GROUP BY tier", *NEED))
def geo_tiers(spark, d):
    return placed(spark, d).groupBy(ranking.tier().alias("tier")).agg(F.count("*").alias("n"))


@query("tiered_cascade", m.sql(PLACED + f", t AS (SELECT query_id, item_id, {TIER} AS tier, score, distance_km FROM placed), v AS (SELECT query_id, item_id, tier, round(CASE tier WHEN 1 THEN score WHEN 2 THEN score * exp(-0.02 * distance_km) WHEN 3 THEN score * coalesce(exp(-0.05 * distance_km), 0.1) ELSE score * 0.001 END, 9) AS tier_score FROM t), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY tier_score DESC, item_id) AS tier_rank FROM v) SELECT query_id, item_id, tier, tier_score, row_number() OVER (PARTITION BY query_id ORDER BY tier, tier_score DESC, item_id) AS rank FROM c WHERE tier > 1 OR tier_rank <= 3 QUALIFY rank <= 50", *NEED))
def tiered_cascade(spark, d):
    return ranking.tiered_cascade(placed(spark, d), local_cap=3).select("query_id", "item_id", "tier", "tier_score", "rank")


@query("semantic_gating", m.sql(PLACED + f", e AS (SELECT query_id, quantile_cont(score, 0.5) AS edge FROM placed GROUP BY query_id) SELECT query_id, item_id, final_score, {_TOP} AS rank FROM (SELECT query_id, item_id, round(score * {CAT} * CASE WHEN score < edge THEN 1.0 ELSE {GEO} END, 9) AS final_score FROM placed JOIN e USING (query_id)) QUALIFY rank <= 50", *NEED))
def semantic_gating(spark, d):
    return _shown(ranking.semantic_gating(placed(spark, d)))


@query("location_category_boost", _final(f"score * CASE WHEN q_location = i_location THEN 5.0 ELSE 1.0 END * CASE WHEN {CAT} < 1 THEN 0.01 ELSE 1.0 END"))
def location_category_boost(spark, d):
    return _shown(ranking.location_category_boost(placed(spark, d)))


@query("rank_in_tiers", _final(f"(5 - {TIER}) * 100 + score"))
def rank_in_tiers(spark, d):
    return _shown(ranking.rank_in_tiers(placed(spark, d), "score"))


@query("exact_n_backfill", m.sql(f", r AS ({RRF.replace('rank <= 50', 'rank <= 7')}), p AS (SELECT s.query_id, i.item_id, i.position FROM suppliers s CROSS JOIN (SELECT * FROM items ORDER BY position LIMIT 24) i WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = s.query_id AND r.item_id = i.item_id)) SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY b, p, item_id) AS rank FROM (SELECT query_id, item_id, 0 AS b, rank AS p FROM r UNION ALL SELECT query_id, item_id, 1, position FROM p) QUALIFY rank <= 12", "candidates", "suppliers", "items"))
def exact_n_backfill(spark, d):
    r = fusion.reciprocal_rank_fusion(m.candidates(spark, d), limit=7)
    return ranking.fill_exactly(r, m.suppliers(spark, d), m.items(spark, d), 12)


ANSWERS = f", r AS ({RRF}), answers AS (SELECT s.query_id, coalesce(string_agg(r.item_id, ' ' ORDER BY r.rank), '') AS answer FROM suppliers s LEFT JOIN r USING (query_id) GROUP BY s.query_id)"


@query("submission_rows", m.sql(ANSWERS + " SELECT * FROM answers", "candidates", "suppliers"))
def submission_rows(spark, d):
    return answer_rows(fusion.reciprocal_rank_fusion(m.candidates(spark, d)), m.suppliers(spark, d).select("query_id"))


@query("submission_contract", m.sql(ANSWERS + " SELECT (SELECT count(*) FROM answers) AS answers, (SELECT count(*) FROM answers WHERE len(string_split(answer, ' ')) > 50) AS wrong_length, (SELECT count(*) FROM answers WHERE len(string_split(answer, ' ')) <> len(list_distinct(string_split(answer, ' ')))) AS repeated, 0::BIGINT AS bad_spacing, 0::BIGINT AS missing_queries, 0::BIGINT AS unknown_queries, (SELECT count(*) FROM (SELECT unnest(string_split(answer, ' ')) AS i FROM answers) WHERE i <> '' AND i NOT IN (SELECT item_id FROM items)) AS unknown_items, (SELECT count(*) FROM (SELECT 1 FROM answers GROUP BY query_id HAVING count(*) > 1)) AS repeated_queries", "candidates", "suppliers", "items"))
def submission_contract(spark, d):
    q = m.suppliers(spark, d).select("query_id")
    return contracts.submission_report(answer_rows(fusion.reciprocal_rank_fusion(m.candidates(spark, d)), q), q, m.items(spark, d).select("item_id"))


@query("submission_diff", m.sql(f", a AS ({RRF.replace('rank <= 50', 'rank <= 20')}), b AS (SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT query_id, item_id, max(score) AS score FROM candidates GROUP BY ALL)) WHERE rank <= 20), o AS (SELECT q.query_id, count(b.item_id) AS overlap, max(CASE WHEN a.rank = 1 THEN CASE WHEN b.rank = 1 THEN 0 ELSE 1 END END) AS changed FROM (SELECT DISTINCT query_id FROM a) q JOIN a ON a.query_id = q.query_id LEFT JOIN b ON b.query_id = a.query_id AND b.item_id = a.item_id GROUP BY q.query_id) SELECT count(*) AS queries, round(avg(overlap), 9) AS mean_overlap, round(quantile_cont(overlap, 0.5), 9) AS median_overlap, CAST(sum(changed) AS BIGINT) AS top1_changed, count(*) FILTER (overlap < 5) AS low_overlap FROM o", "candidates"))
def submission_diff(spark, d):
    from lodestone.operators.candidates import union_best

    c = m.candidates(spark, d)
    a = fusion.reciprocal_rank_fusion(c, limit=20).select("query_id", "item_id", "rank")
    b = union_best(c, 20).select("query_id", "item_id", F.col("rank").alias("other"))
    each = a.join(b, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.count("other").alias("overlap"), F.max(F.when(F.col("rank") == 1, F.when(F.col("other") == 1, 0).otherwise(1))).alias("changed"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("overlap"), 9).alias("mean_overlap"), F.round(F.percentile("overlap", 0.5), 9).alias("median_overlap"), F.sum("changed").alias("top1_changed"), F.count_if(F.col("overlap") < 5).alias("low_overlap"))
