"""Exact vector search over all embeddings, every one of them a query too."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import dense, evaluate
from lodestone.plans import mapping as m
from lodestone.plans.registry import query

_DOT = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9)"
_ID = "lpad(CAST({} AS VARCHAR), 16, '0')"
BASE = f"WITH v AS (SELECT {_ID.format('vec_id')} AS id, embedding, label FROM embeddings), s AS (SELECT a.id AS query_id, b.id AS item_id, a.label AS ql, b.label AS il, {_DOT} AS score FROM v a CROSS JOIN v b)"
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)"
_ROUTE = "(il = ql OR il = (ql + 3) % 10)"


def vectors(spark, d):
    e = m.table(spark, d, "embeddings").select(m.padded("vec_id").alias("item_id"), "embedding", F.col("label").alias("route"))
    return e, e.select(F.col("item_id").alias("query_id"), "embedding", F.col("route").alias("label"))


def allowed(q):
    return q.select("query_id", F.explode(F.array("label", (F.col("label") + 3) % 10)).alias("route")).distinct()


@query("dense_exact_topk", BASE + f" SELECT query_id, item_id, score, {_TOP} AS rank FROM s QUALIFY rank <= 10")
def dense_exact_topk(spark, d):
    i, q = vectors(spark, d)
    return dense.exact_top_k(i, q, 10)


@query("dense_routed", BASE + f" SELECT query_id, item_id, score, {_TOP} AS rank FROM s WHERE {_ROUTE} QUALIFY rank <= 10")
def dense_routed(spark, d):
    i, q = vectors(spark, d)
    return dense.routed_top_k(i, q, allowed(q), 10)


@query("dense_routed_fallback", BASE + f", a AS (SELECT query_id, item_id, score FROM s WHERE {_ROUTE} QUALIFY {_TOP} <= 6), b AS (SELECT query_id, item_id, score FROM s QUALIFY {_TOP} <= 5), u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT *, {_TOP} AS rank FROM u QUALIFY rank <= 11")
def dense_routed_fallback(spark, d):
    i, q = vectors(spark, d)
    return dense.routed_top_k(i, q, allowed(q), 6, 5)


@query("dense_recall", BASE + f", t AS (SELECT query_id, item_id, {_TOP} AS rank FROM s WHERE query_id <> item_id QUALIFY rank <= 20), r AS (SELECT query_id, count(*) AS n FROM s WHERE ql = il AND query_id <> item_id GROUP BY query_id), k(k) AS (VALUES (5), (10), (20)) SELECT k, round(avg(coalesce(h, 0) / n), 9) AS recall, count(*) AS queries FROM r CROSS JOIN k LEFT JOIN (SELECT k AS kk, t.query_id, count(*) AS h FROM t JOIN s USING (query_id, item_id) JOIN k ON rank <= k WHERE ql = il GROUP BY ALL) x ON x.kk = k AND x.query_id = r.query_id GROUP BY k")
def dense_recall(spark, d):
    i, q = vectors(spark, d)
    found = dense.exact_top_k(i, q, 21).where("query_id <> item_id")
    from lodestone.operators.candidates import top_k

    return evaluate.same_label_recall(top_k(found.drop("rank"), 20), i.select(F.col("item_id").alias("id"), F.col("route").alias("label")), (5, 10, 20))


@query("vector_contract", "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS keys, CAST(min(len(embedding)) AS INTEGER) AS least, CAST(max(len(embedding)) AS INTEGER) AS greatest, count(*) FILTER (embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS bad FROM embeddings")
def vector_contract(spark, d):
    return dense.validate_vectors(m.table(spark, d, "embeddings"), "vec_id")


_CODE = "list_sum(list_transform(range(1, length(title) + 1), lambda i: ord(substr(title, i, 1))))"


@query("encoder_stub_topk", m.sql(f", e AS (SELECT item_id, length(title)::DOUBLE AS x, ({_CODE} % 97 + 1)::DOUBLE AS y FROM items), q AS (SELECT query_id, length(title)::DOUBLE AS x, ({_CODE} % 97 + 1)::DOUBLE AS y FROM queries), s AS (SELECT query_id, item_id, round((e.x * q.x + e.y * q.y) / (sqrt(e.x * e.x + e.y * e.y) * sqrt(q.x * q.x + q.y * q.y)), 9) AS score FROM q CROSS JOIN e) SELECT *, {_TOP} AS rank FROM s QUALIFY rank <= 5", "items", "queries"))
def encoder_stub_topk(spark, d):
    i = dense.encode(m.items(spark, d), "item_id", "title", dense.length_sum_encoder, 2)
    q = dense.encode(m.queries(spark, d), "query_id", "title", dense.length_sum_encoder, 2)
    return dense.exact_top_k(i, q, 5)
