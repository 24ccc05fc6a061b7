"""Profiles, shares, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import eda
from lodestone.plans import mapping as m
from lodestone.plans.registry import query

_PROFILED = ("search_query", "search_location_id", "search_infm_params_text", "item_id")


@query("table_profile", m.sql("SELECT (SELECT count(*) FROM train) AS rows, " + ", ".join(f"(SELECT count(*) FROM train WHERE {c} IS NULL) AS {c}_nulls" for c in _PROFILED) + ", (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM train GROUP BY " + ", ".join(_PROFILED) + ")) AS duplicate_rows", "train"))
def table_profile(spark, d):
    return eda.table_profile(m.train(spark, d).select(*_PROFILED))


_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("query_volume_quantiles", m.sql(", e AS (SELECT query_id, count(*) AS rows, count(DISTINCT item_id) AS items FROM interactions GROUP BY query_id), s(share) AS (VALUES " + ", ".join(f"({s}::DOUBLE)" for s in _SHARES) + ") SELECT share, round((SELECT list_extract(quantile_cont(rows, [0.05, 0.25, 0.5, 0.75, 0.95]), i) FROM e), 9) AS rows_per_query, round((SELECT list_extract(quantile_cont(items, [0.05, 0.25, 0.5, 0.75, 0.95]), i) FROM e), 9) AS items_per_query FROM (SELECT share, row_number() OVER (ORDER BY share) AS i FROM s)", "interactions"))
def query_volume_quantiles(spark, d):
    return eda.volume_quantiles(m.interactions(spark, d), _SHARES)


def _describe(c):
    q = ", ".join(f"round(quantile_cont({c}, {s}), 9) AS p{round(100 * s):02d}" for s in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {q} FROM part"


@query("numeric_describe", _describe("p_size") + " UNION ALL " + _describe("p_retailprice"))
def numeric_describe(spark, d):
    return eda.describe(m.table(spark, d, "part"), ["p_size", "p_retailprice"])


@query("value_share", "SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY event_type")
def value_share(spark, d):
    return eda.value_shares(m.table(spark, d, "events"), "event_type")


@query("popularity_top50_share", m.sql(", c AS (SELECT item_id, count(*) AS c FROM train GROUP BY item_id) SELECT round((SELECT sum(c) FROM (SELECT c FROM c ORDER BY c DESC, item_id LIMIT 50)) / sum(c), 9) AS top_share, CAST(sum(c) AS BIGINT) AS rows, count(*) AS items FROM c", "train"))
def popularity_top50_share(spark, d):
    return eda.top_share(m.train(spark, d))


@query("item_list_by_frequency", m.sql("SELECT search_query, string_agg(item_id, ' ' ORDER BY n DESC, item_id) AS items FROM (SELECT search_query, item_id, count(*) AS n FROM train GROUP BY ALL) GROUP BY search_query", "train"))
def item_list_by_frequency(spark, d):
    n = m.train(spark, d).groupBy("search_query", "item_id").agg(F.count("*").alias("n"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("f"), "item_id"))), lambda x: x["item_id"])
    return n.groupBy("search_query").agg(F.array_join(ids, " ").alias("items"))


@query("coverage_summary", m.sql("SELECT round(count(*) FILTER (search_location_id = l) / count(*), 9) AS same_location, round(count(*) FILTER (search_category = c) / count(*), 9) AS same_category, round(avg(search_is_delivery_search), 9) AS delivery FROM (SELECT t.*, i.location AS l, i.category AS c FROM train t JOIN items i USING (item_id))", "train", "items"))
def coverage_summary(spark, d):
    t = m.train(spark, d).join(m.items(spark, d).select("item_id", F.col("location").alias("l"), F.col("category").alias("c")), "item_id")
    return t.agg(F.round(F.count_if(F.col("search_location_id") == F.col("l")) / F.count("*"), 9).alias("same_location"), F.round(F.count_if(F.col("search_category") == F.col("c")) / F.count("*"), 9).alias("same_category"), F.round(F.avg("search_is_delivery_search"), 9).alias("delivery"))


@query("positive_pair_audit", m.sql("SELECT search_is_delivery_search AS delivery, count(*) AS n, round(avg(CASE WHEN search_location_id = i.location THEN 1.0 ELSE 0.0 END), 9) AS same_location FROM train t JOIN items i USING (item_id) GROUP BY 1", "train", "items"))
def positive_pair_audit(spark, d):
    t = m.train(spark, d).join(m.items(spark, d).select("item_id", "location"), "item_id")
    return t.groupBy(F.col("search_is_delivery_search").alias("delivery")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("search_location_id") == F.col("location"), 1.0).otherwise(0.0)), 9).alias("same_location"))


_TWO = ", a AS (SELECT * FROM train WHERE search_is_delivery_search = 1), b AS (SELECT * FROM train WHERE search_is_delivery_search = 0)"


def _two(spark, d):
    t = m.train(spark, d)
    return t.where("search_is_delivery_search = 1"), t.where("search_is_delivery_search = 0")


@query("drift_tv_js", m.sql(_TWO + ", s AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT microcat, count(*) / (SELECT count(*) FROM a) AS p FROM a GROUP BY microcat) x FULL JOIN (SELECT microcat, count(*) / (SELECT count(*) FROM b) AS q FROM b GROUP BY microcat) y USING (microcat)) SELECT round(0.5 * sum(abs(p - q)), 9) AS total_variation, round(0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 9) AS js_bits FROM s", "train"))
def drift_tv_js(spark, d):
    a, b = _two(spark, d)
    return eda.drift(a, b, "microcat")


@query("drift_ks", m.sql(_TWO + ", v AS (SELECT price, sum(x) AS x, sum(y) AS y FROM (SELECT price, 1 AS x, 0 AS y FROM a UNION ALL SELECT price, 0, 1 FROM b) GROUP BY price), r AS (SELECT sum(x) OVER (ORDER BY price) AS x, sum(y) OVER (ORDER BY price) AS y FROM v) SELECT round(max(abs(x / (SELECT count(*) FROM a) - y / (SELECT count(*) FROM b))), 9) AS ks FROM r", "train"))
def drift_ks(spark, d):
    a, b = _two(spark, d)
    return eda.ks_statistic(a, b, "price")


@query("quantile_delta", m.sql(_TWO + " SELECT share, round((SELECT list_extract(quantile_cont(price, [0.05, 0.25, 0.5, 0.75, 0.95]), i) FROM b) - (SELECT list_extract(quantile_cont(price, [0.05, 0.25, 0.5, 0.75, 0.95]), i) FROM a), 9) AS delta FROM (SELECT share, row_number() OVER (ORDER BY share) AS i FROM (VALUES (0.05::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.95::DOUBLE)) AS s(share))", "train"))
def quantile_delta(spark, d):
    a, b = _two(spark, d)
    return eda.quantile_delta(a, b, "price", _SHARES)


@query("shift_report", m.sql(_TWO + ", x AS (SELECT search_category, round(count(*) / (SELECT count(*) FROM a), 9) AS p FROM a GROUP BY ALL), y AS (SELECT search_category, round(count(*) / (SELECT count(*) FROM b), 9) AS q FROM b GROUP BY ALL) SELECT search_category, coalesce(p, 0) AS p, coalesce(q, 0) AS q, round(coalesce(q, 0) - coalesce(p, 0), 9) AS shift FROM x FULL JOIN y USING (search_category)", "train"))
def shift_report(spark, d):
    a, b = _two(spark, d)
    share = lambda df, c: eda.value_shares(df, "search_category").select(F.col("value").alias("search_category"), F.col("share").alias(c))
    both = share(a, "p").join(share(b, "q"), "search_category", "full").fillna(0.0, ["p", "q"])
    return both.withColumn("shift", F.round(F.col("q") - F.col("p"), 9))
