"""Learned selection, re-ranking, resampling: without SQL, as their numbers depend on solvers or hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluate, fusion, ml, splits
from lodestone.plans import mapping as m
from lodestone.plans.candidate_queries import SOURCES
from lodestone.plans.registry import query


def _table(spark, d):
    f = fusion.filled_features(fusion.pair_features(m.candidates(spark, d), SOURCES), SOURCES, 50)
    return fusion.labelled(f, m.truth(spark, d))


@query("selector_gbt_topk")
def selector_gbt_topk(spark, d):
    t = _table(spark, d)
    model = ml.train_selector(t)
    return ml.rank_with_selector(model, t, 20).select("query_id", "item_id", "final_score", "rank")


def overlap_scorer(queries: list[str], items: list[str]) -> list[float]:
    """Shared words over the query's: a stand-in for a cross-encoder."""
    return [len(set(q.split()) & set(i.split())) / max(1, len(set(q.split()))) for q, i in zip(queries, items, strict=True)]


@query("rerank_stub_topk", m.sql(", s AS (SELECT q.query_id, i.item_id, len(list_intersect(string_split(q.text, ' '), string_split(i.title || ' ' || i.params, ' '))) / len(list_distinct(string_split(q.text, ' '))) AS rerank_score FROM queries q JOIN items i USING (microcat)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, item_id) AS rank FROM s QUALIFY rank <= 10", "queries", "items"))
def rerank_stub_topk(spark, d):
    q = m.queries(spark, d).select("query_id", F.col("text").alias("query_text"), "microcat")
    pairs = q.join(m.items(spark, d).select("item_id", F.concat_ws(" ", "title", "params").alias("item_text"), "microcat"), "microcat")
    return ml.rerank(pairs, overlap_scorer, 10)


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    each = evaluate.query_recall(m.candidates(spark, d), m.truth(spark, d), [20])
    return evaluate.bootstrap_means(each, "recall")


@query("paired_bootstrap_ci")
def paired_bootstrap_ci(spark, d):
    c, t = m.candidates(spark, d), m.truth(spark, d)
    one = evaluate.query_recall(c.where("source = 'A'"), t, [20]).select("query_id", F.col("recall").alias("a"))
    other = evaluate.query_recall(c.where("source = 'N'"), t, [20]).select("query_id", F.col("recall").alias("b"))
    return evaluate.bootstrap_means(one.join(other, "query_id").select("query_id", (F.col("b") - F.col("a")).alias("gain")), "gain")


@query("stratified_sample", m.sql("SELECT DISTINCT query_id, search_category, is_long FROM (SELECT query_id, search_category, length(search_query) > 9 AS is_long FROM interactions) QUALIFY dense_rank() OVER (PARTITION BY search_category, is_long ORDER BY sha256('42:' || query_id), query_id) <= 20", "interactions"))
def stratified_sample(spark, d):
    q = m.interactions(spark, d).select("query_id", "search_category", (F.length("search_query") > 9).alias("is_long")).distinct()
    return splits.stratified_sample(q, ["search_category", "is_long"], 20)


#: Distinct pairs that the towers train on at most, first in the order of a hash.
PAIRS = 50_000


def trained_tower(spark, d, epochs=50):
    """Towers of the reference's size, trained on the distinct (query text, item title) pairs of the interactions."""
    titles = m.items(spark, d).select("item_id", "title")
    pairs = m.train(spark, d).join(titles, "item_id").select("search_query", "title").distinct()
    pairs = pairs.orderBy(F.xxhash64("search_query", "title"), "search_query", "title").limit(PAIRS)
    model = ml.TwoTower(vocabulary=65537, width=32, dimension=32)
    ml.train_two_tower(model, [tuple(r) for r in pairs.collect()], epochs)
    return model


@query("two_tower_topk")
def two_tower_topk(spark, d):
    from lodestone.operators import dense

    model = trained_tower(spark, d)
    i = dense.encode(m.items(spark, d), "item_id", "title", model.encoder("item"), model.dimension)
    q = dense.encode(m.queries(spark, d), "query_id", "title", model.encoder("query"), model.dimension)
    return dense.exact_top_k(i, q, 5)
