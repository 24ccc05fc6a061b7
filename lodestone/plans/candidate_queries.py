"""The candidate algebra: ranking, union, fusion, features, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import candidates as cand
from lodestone.operators import evaluate, fusion
from lodestone.plans import mapping as m
from lodestone.plans.registry import query

SOURCES = ("A", "N", "R")
WEIGHTS = {"A": 1.5, "N": 1.2, "R": 0.0}
_W = "CASE source WHEN 'A' THEN 1.5 WHEN 'N' THEN 1.2 ELSE 0.0 END"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, item_id)"


@query("rank_candidates", m.sql(f"SELECT *, {_RANK.format('score')} AS rank FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY score DESC, source) = 1) QUALIFY rank <= 50", "scored"))
def rank_candidates(spark, d):
    return cand.rank_candidates(m.scored(spark, d))


@query("rank_predictions_two_keys", m.sql("SELECT query_id, item_id, final_score, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rrf_score DESC, item_id) AS rank FROM (SELECT query_id, item_id, round(max(score) / 10, 0) AS final_score, coalesce(max(CASE WHEN source = 'A' THEN score END), 0.0) AS rrf_score FROM scored GROUP BY query_id, item_id) QUALIFY rank <= 50", "scored"))
def rank_predictions_two_keys(spark, d):
    g = m.scored(spark, d).groupBy("query_id", "item_id").agg(F.round(F.max("score") / 10, 0).alias("final_score"), F.max(F.when(F.col("source") == "A", F.col("score"))).alias("rrf_score"))
    return cand.rank_predictions(g)


@query("topk_pairs", m.sql("SELECT DISTINCT query_id, item_id, source FROM candidates WHERE rank <= 10", "candidates"))
def topk_pairs(spark, d):
    return cand.top_k_pairs(m.candidates(spark, d), 10)


@query("union_dedup_max_score", m.sql(f"SELECT *, {_RANK.format('score')} AS rank FROM (SELECT query_id, item_id, max(score) AS score FROM candidates GROUP BY query_id, item_id) QUALIFY rank <= 50", "candidates"))
def union_dedup_max_score(spark, d):
    return cand.union_best(m.candidates(spark, d), 50)


RRF = f"SELECT *, {_RANK.format('rrf_score')} AS rank FROM (SELECT query_id, item_id, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, count(DISTINCT source) AS retriever_count FROM candidates GROUP BY query_id, item_id) QUALIFY rank <= 50"


@query("rrf_unweighted", m.sql(RRF, "candidates"))
def rrf_unweighted(spark, d):
    return fusion.reciprocal_rank_fusion(m.candidates(spark, d))


@query("rrf_weighted", m.sql(f"SELECT *, {_RANK.format('score')} AS rank FROM (SELECT query_id, item_id, round(sum(CAST({_W} AS DOUBLE) / (60 + rank)), 9) AS score FROM candidates GROUP BY query_id, item_id) QUALIFY rank <= 100", "candidates"))
def rrf_weighted(spark, d):
    return fusion.weighted_rrf(m.candidates(spark, d), WEIGHTS, limit=100)


GRID = [(f"c{c}w{w}", c, s, float(x)) for c in (20, 60) for w in (0, 1, 2) for s, x in (("A", 1), ("N", w), ("R", 0.5))]


@query("rrf_weight_grid", m.sql(", grid(config, c, source, weight) AS (VALUES " + ", ".join(f"('{a}', {b}, '{s}', {x}::DOUBLE)" for a, b, s, x in GRID) + ") SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, item_id) AS rank FROM (SELECT config, query_id, item_id, round(sum(weight / (c + rank)), 9) AS score FROM candidates JOIN grid USING (source) GROUP BY ALL) QUALIFY rank <= 20", "candidates"))
def rrf_weight_grid(spark, d):
    return fusion.weighted_rrf_grid(m.candidates(spark, d), spark.createDataFrame(GRID, "config string, c int, source string, weight double"), limit=20)


_PIVOT = ", ".join(f"max(CASE WHEN source = '{s}' THEN score END) AS \"{s}_score\", min(CASE WHEN source = '{s}' THEN rank END) AS \"{s}_rank\", max(CASE WHEN source = '{s}' THEN 1 ELSE 0 END) AS \"{s}_present\"" for s in SOURCES)
PAIRS = f"SELECT query_id, item_id, {_PIVOT}, CAST(count(DISTINCT source) AS INTEGER) AS retriever_count FROM candidates GROUP BY query_id, item_id"


_ZERO = ", ".join(f"coalesce(\"{s}_score\", -1.0) AS \"{s}_score\", coalesce(\"{s}_rank\", 0) AS \"{s}_rank\", \"{s}_present\"" for s in SOURCES)


@query("pair_features_pivot", m.sql(f", f AS ({PAIRS}) SELECT query_id, item_id, {_ZERO}, retriever_count FROM f", "candidates"))
def pair_features_pivot(spark, d):
    return fusion.pair_features(m.candidates(spark, d), SOURCES).fillna({f"{s}_{k}": v for s in SOURCES for k, v in (("score", -1.0), ("rank", 0))})


_FILL = ", ".join(f"coalesce(\"{s}_score\", (SELECT min(\"{s}_score\") - 1 FROM f)) AS \"{s}_score\", coalesce(\"{s}_rank\", 51) AS \"{s}_rank\", \"{s}_present\"" for s in SOURCES)


@query("selector_features_filled", m.sql(f", f AS ({PAIRS}) SELECT query_id, item_id, {_FILL}, retriever_count FROM f", "candidates"))
def selector_features_filled(spark, d):
    return fusion.filled_features(fusion.pair_features(m.candidates(spark, d), SOURCES), SOURCES, 50)


@query("oof_labels", m.sql(f", f AS ({PAIRS}) SELECT query_id, item_id, retriever_count, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS label, 0 AS fold FROM f LEFT JOIN truth t USING (query_id, item_id)", "candidates", "truth").replace("t.item_id IS NULL", "t.hit IS NULL").replace("LEFT JOIN truth t USING", "LEFT JOIN (SELECT *, 1 AS hit FROM truth) t USING"))
def oof_labels(spark, d):
    f = fusion.pair_features(m.candidates(spark, d), SOURCES).select("query_id", "item_id", "retriever_count")
    return fusion.labelled(f, m.truth(spark, d), 0)


_NORM = "SELECT query_id, item_id, source, round(score / (max(score) OVER q + 1e-9), 9) AS score_norm, round(max(score) OVER q - score, 9) AS score_diff, round((score - avg(score) OVER q) / (coalesce({f}(score) OVER q, 1.0) + 1e-9), 6) AS score_z, count(*) OVER q AS n_candidates FROM candidates WINDOW q AS (PARTITION BY query_id)"


def _norm(spark, d, population):
    n = cand.normalized_scores(m.candidates(spark, d), population)
    return n.select("query_id", "item_id", "source", F.round("score_norm", 9).alias("score_norm"), F.round("score_diff", 9).alias("score_diff"), F.round("score_z", 6).alias("score_z"), "n_candidates")


@query("score_norm_window", m.sql(_NORM.format(f="stddev_samp"), "candidates"))
def score_norm_window(spark, d):
    return _norm(spark, d, False)


@query("score_norm_population", m.sql(_NORM.format(f="stddev_pop"), "candidates"))
def score_norm_population(spark, d):
    return _norm(spark, d, True)


EACH = ", ks(k) AS (VALUES (1), (5), (10), (20), (50)), rel AS (SELECT query_id, count(*) AS relevant FROM truth GROUP BY query_id), hit AS (SELECT k, query_id, count(DISTINCT item_id) AS hits FROM candidates JOIN truth USING (query_id, item_id) JOIN ks ON rank <= k {where} GROUP BY k, query_id), each AS (SELECT ks.k, rel.query_id, relevant, coalesce(hits, 0) AS hits, coalesce(hits, 0) / relevant AS recall FROM rel CROSS JOIN ks LEFT JOIN hit ON hit.k = ks.k AND hit.query_id = rel.query_id)"
KS = (1, 5, 10, 20, 50)


@query("recall_at_ks", m.sql(EACH.format(where="WHERE source = 'A'") + " SELECT k, round(avg(recall), 9) AS recall, count(*) AS queries FROM each GROUP BY k", "candidates", "truth"))
def recall_at_ks(spark, d):
    return evaluate.recall_at(m.candidates(spark, d).where("source = 'A'"), m.truth(spark, d), KS)


@query("recall_query_base", m.sql(EACH.format(where="WHERE source = 'A'") + " SELECT ks.k, round(avg(coalesce(recall, 0)), 9) AS recall, count(*) AS queries FROM suppliers s CROSS JOIN ks LEFT JOIN each ON each.k = ks.k AND each.query_id = s.query_id GROUP BY ks.k", "candidates", "truth", "suppliers"))
def recall_query_base(spark, d):
    return evaluate.recall_over_queries(m.candidates(spark, d).where("source = 'A'"), m.truth(spark, d), m.suppliers(spark, d), KS)


@query("oracle_union_coverage", m.sql(EACH.format(where="") + " SELECT k, round(avg(recall), 9) AS recall, count(*) AS queries FROM each GROUP BY k", "candidates", "truth"))
def oracle_union_coverage(spark, d):
    return evaluate.recall_at(m.candidates(spark, d), m.truth(spark, d), KS)


@query("recovered_positives", m.sql("SELECT count(*) AS recovered FROM (SELECT query_id, item_id FROM candidates JOIN truth USING (query_id, item_id) WHERE source = 'N' AND rank <= 20 EXCEPT SELECT query_id, item_id FROM candidates WHERE source = 'A' AND rank <= 20)", "candidates", "truth"))
def recovered_positives(spark, d):
    c = m.candidates(spark, d)
    return evaluate.recovered(c.where("source = 'A'"), c.where("source = 'N'"), m.truth(spark, d), 20)


def _ab(extra):
    one = EACH.format(where="WHERE source = 'A'")
    two = EACH.format(where="WHERE source IN ('A', 'N')").replace("each AS", "each2 AS").replace("hit AS", "hit2 AS").replace("hit ON hit.k = ks.k AND hit.query_id", "hit2 ON hit2.k = ks.k AND hit2.query_id").split(", hit2 AS", 1)[1]
    return m.sql(one + ", hit2 AS" + two + extra, "candidates", "truth")


@query("incremental_coverage", _ab(" SELECT a.k, round(avg(a.recall), 9) AS base_recall, round(avg(b.recall), 9) AS union_recall, round(greatest(0, round(avg(b.recall), 9) - round(avg(a.recall), 9)), 9) AS gain FROM each a JOIN each2 b USING (k, query_id) GROUP BY a.k"))
def incremental_coverage(spark, d):
    c = m.candidates(spark, d)
    return evaluate.incremental_coverage(c.where("source = 'A'"), c.where("source = 'N'"), m.truth(spark, d), KS)


@query("leave_one_out_coverage", m.sql(", h AS (SELECT DISTINCT query_id, item_id, source FROM candidates JOIN truth USING (query_id, item_id) WHERE rank <= 50), n AS (SELECT *, count(*) OVER (PARTITION BY query_id, item_id) AS n FROM h) SELECT source, count(*) AS hits, count(*) FILTER (n = 1) AS unique_hits FROM n GROUP BY source", "candidates", "truth"))
def leave_one_out_coverage(spark, d):
    return evaluate.unique_contributions(m.candidates(spark, d), m.truth(spark, d), 50)


@query("slice_recall", m.sql(EACH.format(where="") + " SELECT 'category_' || category AS slice, round(avg(recall), 9) AS recall, count(*) AS queries FROM each JOIN suppliers USING (query_id) WHERE k = 20 GROUP BY 1", "candidates", "truth", "suppliers"))
def slice_recall(spark, d):
    s = m.suppliers(spark, d).select("query_id", F.concat(F.lit("category_"), "category").alias("slice"))
    return evaluate.slice_recall(m.candidates(spark, d), m.truth(spark, d), s, 20)


@query("seen_unseen_grouping_sets", m.sql(EACH.format(where="") + ", s AS (SELECT recall, is_seen FROM each JOIN suppliers USING (query_id) WHERE k = 20) SELECT 'overall' AS segment, round(avg(recall), 9) AS recall, count(*) AS queries FROM s UNION ALL SELECT CASE WHEN is_seen THEN 'seen' ELSE 'unseen' END, round(avg(recall), 9), count(*) FROM s GROUP BY is_seen", "candidates", "truth", "suppliers"))
def seen_unseen_grouping_sets(spark, d):
    return evaluate.seen_and_overall(m.candidates(spark, d), m.truth(spark, d), m.suppliers(spark, d).select("query_id", "is_seen"), 20)


@query("proxy_score", m.sql(EACH.format(where="") + " SELECT round(0.35 * coalesce(avg(recall) FILTER (is_seen), 0) + 0.65 * coalesce(avg(recall) FILTER (NOT is_seen), 0), 9) AS proxy FROM each JOIN suppliers USING (query_id) WHERE k = 20", "candidates", "truth", "suppliers"))
def proxy_score(spark, d):
    return evaluate.proxy_score(m.candidates(spark, d), m.truth(spark, d), m.suppliers(spark, d).select("query_id", "is_seen"), 20)


@query("recall_monotonic_check", m.sql(EACH.format(where="") + ", r AS (SELECT k, round(avg(recall), 9) AS recall, count(*) AS queries FROM each GROUP BY k) SELECT *, coalesce(recall + 1e-9 >= lag(recall) OVER (ORDER BY k), true) AS ok FROM r", "candidates", "truth"))
def recall_monotonic_check(spark, d):
    return evaluate.monotonic(evaluate.recall_at(m.candidates(spark, d), m.truth(spark, d), KS))


@query("hit_quadrants", m.sql(", f AS (SELECT t.*, EXISTS (SELECT 1 FROM candidates c WHERE c.query_id = t.query_id AND c.item_id = t.item_id AND source = 'A' AND rank <= 20) AS a, EXISTS (SELECT 1 FROM candidates c WHERE c.query_id = t.query_id AND c.item_id = t.item_id AND source = 'N' AND rank <= 20) AS b FROM truth t) SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second, count(*) FILTER (NOT a AND NOT b) AS neither FROM f", "candidates", "truth"))
def hit_quadrants(spark, d):
    c = m.candidates(spark, d)
    return evaluate.hit_quadrants(c.where("source = 'A'"), c.where("source = 'N'"), m.truth(spark, d), 20)


@query("rank_bucket_histogram", m.sql(", b AS (SELECT query_id, item_id, min(rank) AS rank FROM candidates GROUP BY ALL) SELECT CASE WHEN rank IS NULL THEN 'missing' WHEN rank <= 10 THEN '<=10' WHEN rank <= 20 THEN '<=20' WHEN rank <= 40 THEN '<=40' ELSE '>40' END AS bucket, count(*) AS pairs FROM truth LEFT JOIN b USING (query_id, item_id) GROUP BY 1", "candidates", "truth"))
def rank_bucket_histogram(spark, d):
    return evaluate.rank_buckets(m.candidates(spark, d), m.truth(spark, d), (10, 20, 40))


@query("branch_jaccard", m.sql(", p AS (SELECT DISTINCT source, query_id, item_id FROM candidates WHERE rank <= 50), n AS (SELECT source, count(*) AS n FROM p GROUP BY source) SELECT x.source AS a, y.source AS b, count(*) AS both, round(count(*) / greatest(1, any_value(n1.n) + any_value(n2.n) - count(*)), 9) AS jaccard FROM p x JOIN p y ON x.query_id = y.query_id AND x.item_id = y.item_id AND x.source < y.source JOIN n n1 ON n1.source = x.source JOIN n n2 ON n2.source = y.source GROUP BY x.source, y.source", "candidates"))
def branch_jaccard(spark, d):
    return evaluate.source_overlap(m.candidates(spark, d), 50)
