"""Routing of query texts to brands, learned from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import routing
from lodestone.plans import mapping as m
from lodestone.plans.registry import query

K = 5
_ASKED = ", asked AS (SELECT DISTINCT query AS query_id, query FROM history UNION ALL SELECT 'new ' || query_id, 'new ' || title FROM queries)"
_COUNTS = _ASKED + ", c AS (SELECT query, category, count(*) AS n FROM history GROUP BY ALL), p AS (SELECT *, round(n / sum(n) OVER (PARTITION BY query), 9) AS probability, row_number() OVER (PARTITION BY query ORDER BY n DESC, category) AS rank FROM c), g AS (SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS rank FROM history GROUP BY category)"
NEED = ("history", "queries")


def asked(spark, d):
    known = m.history(spark, d).select("query").distinct().select(F.col("query").alias("query_id"), "query")
    new = m.queries(spark, d).select(F.concat(F.lit("new "), "query_id").alias("query_id"), F.concat(F.lit("new "), "title").alias("query"))
    return known.unionByName(new)


@query("posterior_proba", m.sql(_COUNTS + f" SELECT query_id, category, probability, rank FROM asked JOIN p USING (query) WHERE rank <= {K}", *NEED))
def posterior_proba(spark, d):
    return routing.posterior_probabilities(m.history(spark, d), asked(spark, d), K)


@query("posterior_topk", m.sql(_COUNTS + f" SELECT query_id, category, rank FROM asked JOIN p USING (query) WHERE rank <= {K} UNION ALL SELECT query_id, category, rank FROM asked CROSS JOIN g WHERE rank <= {K} AND query NOT IN (SELECT query FROM c)", *NEED))
def posterior_topk(spark, d):
    return routing.posterior_top_k(m.history(spark, d), asked(spark, d), K)


@query("posterior_prior", m.sql(_COUNTS + " SELECT category, n, rank FROM g", *NEED))
def posterior_prior(spark, d):
    return routing.prior(m.history(spark, d))


@query("posterior_backfill", m.sql(_COUNTS + ", u AS (SELECT query_id, category, 0 AS b, rank AS r FROM asked JOIN p USING (query) WHERE rank <= 24 UNION ALL SELECT query_id, g.category, 1, g.rank FROM asked CROSS JOIN g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query = asked.query AND c.category = g.category)) SELECT query_id, category, row_number() OVER (PARTITION BY query_id ORDER BY b, r) AS rank FROM u QUALIFY rank <= 24", *NEED))
def posterior_backfill(spark, d):
    return routing.posterior_top_k(m.history(spark, d), asked(spark, d), 24, backfill=True)


@query("routing_support", m.sql(_COUNTS + " SELECT query_id, coalesce(n, 0) AS support, n IS NOT NULL AS is_seen FROM asked LEFT JOIN (SELECT query, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY query) USING (query)", *NEED))
def routing_support(spark, d):
    return routing.support(m.history(spark, d), asked(spark, d))


_CLS = ", cls AS (SELECT query_id, category, n / t AS probability FROM asked CROSS JOIN (SELECT category, n, sum(n) OVER () AS t FROM g WHERE rank <= 3) WHERE length(query) % 2 = 0), sup AS (SELECT query_id, query, coalesce(n, 0) AS support FROM asked LEFT JOIN (SELECT query, sum(n) AS n FROM c GROUP BY query) USING (query))"


def classifier(spark, d):
    """A stand-in with fixed guesses for half of the queries."""
    from pyspark.sql import Window

    top = routing.prior(m.history(spark, d), 3).withColumn("t", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return asked(spark, d).where(F.length("query") % 2 == 0).crossJoin(F.broadcast(top)).select("query_id", "category", (F.col("n") / F.col("t")).alias("probability"))


def _hybrid(mid, least):
    return m.sql(_COUNTS + _CLS + f""", e AS (SELECT query_id, support, category, n / sum(n) OVER (PARTITION BY query_id) AS probability FROM sup JOIN c USING (query)), u AS (SELECT query_id, category, probability FROM e WHERE support >= {least} UNION ALL {mid}
 UNION ALL SELECT s.query_id, g.category, g.n / (SELECT sum(n) FROM g) FROM sup s CROSS JOIN g WHERE support < {least} AND s.query_id NOT IN (SELECT query_id FROM cls)), r AS (SELECT query_id, category, round(sum(probability), 9) AS probability FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, category) AS rank FROM r QUALIFY rank <= {K}""", *NEED)


@query("hybrid_fallback", _hybrid("SELECT query_id, category, probability FROM cls JOIN sup USING (query_id) WHERE support < 180", 180))
def hybrid_fallback(spark, d):
    return routing.hybrid(m.history(spark, d), asked(spark, d), classifier(spark, d), K, min_count=180)


@query("hybrid_blend", _hybrid("SELECT query_id, category, CASE WHEN support > 0 THEN (1 - support / 180.0::DOUBLE) * probability ELSE probability END FROM cls JOIN sup USING (query_id) WHERE support < 180 UNION ALL SELECT query_id, category, support / 180.0::DOUBLE * probability FROM e WHERE support < 180 AND query_id IN (SELECT query_id FROM cls)", 180))
def hybrid_blend(spark, d):
    return routing.hybrid(m.history(spark, d), asked(spark, d), classifier(spark, d), K, min_count=180, blend=True)


@query("context_microcat_weights", m.sql(", c AS (SELECT query, category, count(*) AS n FROM history GROUP BY ALL) SELECT query, category, n, round(greatest(0.1, least(1.0, ln(1 + n) / ln(1 + sum(n) OVER (PARTITION BY query)))), 9) AS weight FROM c", "history"))
def context_microcat_weights(spark, d):
    return routing.context_weights(m.history(spark, d))


@query("route_expand", m.sql(_COUNTS + f" SELECT query_id, count(*) AS n FROM asked JOIN p USING (query) JOIN items i ON i.microcat = p.category WHERE p.rank <= {K} GROUP BY query_id", "history", "queries", "items"))
def route_expand(spark, d):
    routes = routing.posterior_probabilities(m.history(spark, d), asked(spark, d), K)
    items = m.items(spark, d).select("item_id", F.col("microcat").alias("category"))
    return routing.expand(routes, items).groupBy("query_id").agg(F.count("*").alias("n"))


@query("adaptive_k", m.sql(_COUNTS + ", r AS (SELECT query_id, category, probability, rank FROM asked JOIN p USING (query) WHERE rank <= 15), b AS (SELECT query_id, max(probability) AS best FROM r GROUP BY query_id), e AS (SELECT quantile_cont(best, 0.333) AS lo, quantile_cont(best, 0.667) AS hi FROM b) SELECT query_id, category, probability, rank, CASE WHEN best <= lo THEN 15 WHEN best <= hi THEN 10 ELSE 5 END AS k FROM r JOIN b USING (query_id) CROSS JOIN e WHERE rank <= CASE WHEN best <= lo THEN 15 WHEN best <= hi THEN 10 ELSE 5 END", *NEED))
def adaptive_k(spark, d):
    return routing.adaptive_k(routing.posterior_probabilities(m.history(spark, d), asked(spark, d), 15))


@query("routing_metrics", m.sql(_COUNTS + f""", sizes AS (SELECT microcat AS category, count(*) AS n FROM items GROUP BY microcat), rt AS (SELECT query_id, category FROM asked JOIN p USING (query) WHERE rank <= {K} UNION ALL SELECT query_id, category FROM asked CROSS JOIN g WHERE rank <= {K} AND query NOT IN (SELECT query FROM c)),
 tr AS (SELECT query AS query_id, min(category) AS category, length(query) % 2 = 0 AS is_seen FROM history GROUP BY query), e AS (SELECT query_id, is_seen, CASE WHEN EXISTS (SELECT 1 FROM rt WHERE rt.query_id = tr.query_id AND rt.category = tr.category) THEN 1.0 ELSE 0.0 END AS hit, (SELECT coalesce(sum(n), 0) FROM rt JOIN sizes USING (category) WHERE rt.query_id = tr.query_id) AS size FROM tr),
 s AS (SELECT 'overall' AS segment, hit, size FROM e UNION ALL SELECT CASE WHEN is_seen THEN 'seen' ELSE 'unseen' END, hit, size FROM e)
 SELECT segment, count(*) AS queries, round(avg(hit), 9) AS category_hit, round(avg(size), 9) AS mean_size, CAST(list_sort(list(size))[count(*) // 2 + 1] AS BIGINT) AS median_size, CAST(list_sort(list(size))[least(count(*) - 1, count(*) * 95 // 100) + 1] AS BIGINT) AS p95_size, CAST(max(size) AS BIGINT) AS max_size, round(round(avg(size), 9) / (SELECT sum(n) FROM sizes), 9) AS route_fraction FROM s GROUP BY segment""", "history", "queries", "items"))
def routing_metrics(spark, d):
    h = m.history(spark, d)
    truth = h.groupBy(F.col("query").alias("query_id")).agg(F.min("category").alias("category")).withColumn("is_seen", F.length("query_id") % 2 == 0)
    sizes = m.items(spark, d).groupBy(F.col("microcat").alias("category")).agg(F.count("*").alias("n"))
    return routing.evaluate(routing.posterior_top_k(h, asked(spark, d), K), truth, sizes)


@query("router_classifier_topk")
def router_classifier_topk(spark, d):
    h = m.history(spark, d).select(F.col("query").alias("text"), "category")
    return routing.classifier_routes(h, asked(spark, d).select("query_id", F.col("query").alias("text")), K)
