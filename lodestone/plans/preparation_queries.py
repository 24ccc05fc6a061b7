"""Raw checks, canonical tables, training pairs, the research split, query slices, re-ranking texts, and the routing policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import contracts, evaluate, fusion, ml, preparation, rerank, routing
from lodestone.operators.settle import staged
from lodestone.plans import mapping as m
from lodestone.plans import routing_queries as rt
from lodestone.plans.candidate_queries import SOURCES
from lodestone.plans.registry import query
from lodestone.plans.split_queries import _FOLD, _N
from lodestone.sources import tables

_CONTEXT = ", ".join(preparation.CONTEXT)


def _raw_queries(spark, d):
    return m.interactions(spark, d).select(F.substring("query_id", 1, 16).alias("query_id"), *preparation.CONTEXT).distinct()


@query("raw_report", m.sql(f", q AS (SELECT DISTINCT substr(query_id, 1, 16) AS query_id, {_CONTEXT} FROM interactions) SELECT (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM train WHERE item_id IS NULL OR length(item_id) <> 16) AS train_bad_ids, (SELECT count(*) FROM q) AS query_rows, (SELECT count(*) FROM q WHERE length(query_id) <> 16) AS query_bad_ids, (SELECT count(*) FROM (SELECT 1 FROM q GROUP BY query_id HAVING count(*) > 1)) AS repeated_queries, (SELECT count(*) FROM items) AS item_rows, (SELECT count(*) FROM items WHERE length(item_id) <> 16) AS item_bad_ids, (SELECT count(*) FROM (SELECT 1 FROM items GROUP BY item_id HAVING count(*) > 1)) AS repeated_items, (SELECT count(*) FROM train WHERE search_is_delivery_search NOT IN (0, 1)) AS search_is_delivery_search_not_binary", "interactions", "items"))
def raw_report(spark, d):
    return preparation.raw_report(m.train(spark, d), _raw_queries(spark, d), m.items(spark, d))


def _raw_train(spark, d):
    """The train with an item column beside the id, so that items have several snapshots."""
    return m.train(spark, d).withColumn("item_price", F.col("price")).drop("price", "quantity", "microcat")


_RAW_TRAIN = ", raw AS (SELECT " + _CONTEXT + ", query_id, item_id, price AS item_price FROM interactions)"


@query("canonical_report", m.sql(_RAW_TRAIN + " SELECT (SELECT count(*) FROM raw) AS raw_interactions, (SELECT count(*) FROM (SELECT DISTINCT query_id, item_id FROM raw)) AS unique_interactions, (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT query_id, item_id FROM raw)) AS interaction_duplicates_dropped, (SELECT count(*) FROM (SELECT DISTINCT item_id, item_price FROM raw)) - (SELECT count(DISTINCT item_id) FROM raw) AS item_snapshots_dropped", "interactions"))
def canonical_report(spark, d):
    t = _raw_train(spark, d)
    return preparation.build_report(t, preparation.canonical_tables(t, _raw_queries(spark, d), m.items(spark, d)))


@query("canonical_items", m.sql(_RAW_TRAIN + " SELECT item_id, min(item_price) AS item_price FROM raw GROUP BY item_id", "interactions"))
def canonical_items(spark, d):
    t = _raw_train(spark, d)
    return preparation.canonical_tables(t, _raw_queries(spark, d), m.items(spark, d))["items_train"]


@query("canonical_queries", m.sql(f"SELECT DISTINCT query_id, {_CONTEXT} FROM interactions", "interactions"))
def canonical_queries(spark, d):
    t = _raw_train(spark, d)
    return preparation.canonical_tables(t, _raw_queries(spark, d), m.items(spark, d))["queries_train"]


@query("training_pairs", m.sql("SELECT c.query_id, c.item_id, s.category::VARCHAR AS query_text, i.text AS item_text FROM (SELECT DISTINCT query_id, item_id FROM candidates) c LEFT JOIN suppliers s USING (query_id) LEFT JOIN items i USING (item_id)", "candidates", "suppliers", "items"))
def training_pairs(spark, d):
    q = m.suppliers(spark, d).select("query_id", F.col("category").cast("string").alias("text"))
    return preparation.training_pairs(m.candidates(spark, d).select("query_id", "item_id").distinct(), q, m.items(spark, d).select("item_id", "text"))


_CLEAN = "CASE WHEN length(search_query) % 3 = 0 THEN '  ' ELSE search_query END"


@query("clean_pairs", m.sql(f", t AS (SELECT {_CLEAN} AS search_query, item_id, min(microcat) AS title FROM train GROUP BY ALL), f AS (SELECT * FROM t WHERE trim(search_query) <> '') SELECT search_query, item_id, title FROM f ORDER BY {_N.format(seed=42, key=chr(39) + chr(39) + ' || search_query || ' + chr(39) + '|' + chr(39) + ' || item_id')}, search_query, item_id LIMIT 1500", "train"))
def clean_pairs(spark, d):
    t = m.train(spark, d).select(F.when(F.length("search_query") % 3 == 0, "  ").otherwise(F.col("search_query")).alias("search_query"), "item_id", F.col("microcat").alias("title"))
    return preparation.clean_pairs(t, 1500)


_RESEARCH = f", pos AS (SELECT DISTINCT t.query_id, t.item_id, t.microcat AS train_category, i.microcat AS corpus_category FROM interactions t JOIN items i USING (item_id) WHERE i.category < 4), known AS (SELECT query_id, count(DISTINCT item_id) AS known_positive_count FROM pos GROUP BY query_id), val AS (SELECT DISTINCT query_id, {_FOLD} AS fold FROM interactions WHERE {_FOLD} <> 0)"


def _research(spark, d):
    return preparation.research_split(m.interactions(spark, d), m.items(spark, d).where("category < 4"))


@query("research_positives", m.sql(_RESEARCH + " SELECT * FROM pos", "interactions", "items"))
def research_positives(spark, d):
    return _research(spark, d)["positives"]


@query("research_contexts", m.sql(_RESEARCH + " SELECT query_id, fold, known_positive_count FROM val JOIN known USING (query_id)", "interactions", "items"))
def research_contexts(spark, d):
    return _research(spark, d)["validation_contexts"]


@query("research_truth", m.sql(_RESEARCH + " SELECT DISTINCT query_id, item_id FROM pos JOIN val USING (query_id)", "interactions", "items"))
def research_truth(spark, d):
    return contracts.ground_truth_relation(_research(spark, d)["ground_truth"])


def _asked(spark, d):
    """Queries of which some were asked before, some have no filters, and some more words."""
    q = m.queries(spark, d)
    text = F.when(F.col("location") % 3 == 0, F.col("title")).when(F.col("location") % 3 == 1, F.concat_ws(" ", "title", F.lit("2 new ones"))).otherwise(F.col("text"))
    return q.select("query_id", text.alias("search_query"), F.when(F.col("location") % 2 == 0, " ").otherwise(F.col("params")).alias("params"), "category", "location", F.length("text").alias("position"))


_ASKED = ", asked AS (SELECT query_id, CASE WHEN location % 3 = 0 THEN title WHEN location % 3 = 1 THEN title || ' 2 new ones' ELSE text END AS search_query, CASE WHEN location % 2 = 0 THEN ' ' ELSE params END AS params, category, location, length(text) AS position FROM queries)"
_WORDS = "len(list_filter(string_split(search_query, ' '), lambda w: w <> ''))"
_SLICES = {"seen_query": "search_query IN (SELECT search_query FROM train)", "unseen_query": "search_query NOT IN (SELECT search_query FROM train)", "filters_present": "length(trim(params)) > 0", "filters_absent": "length(trim(params)) = 0", "short_query": f"{_WORDS} <= 2", "long_query": f"{_WORDS} >= 4", "category_0": "category = 0", "category_114": "category = 114"}


@query("query_flags", m.sql(_ASKED + " " + " UNION ALL ".join(f"SELECT query_id, '{n}' AS slice FROM asked WHERE {c}" for n, c in _SLICES.items()), "queries", "train"))
def query_flags(spark, d):
    return preparation.query_flags(_asked(spark, d), m.train(spark, d))


_KINDS = ("category = 0", "regexp_matches(search_query, '[0-9]')", "location IN (SELECT location FROM asked GROUP BY location HAVING count(*) = 1)", f"{_WORDS} >= 4", f"{_WORDS} <= 2")


@query("audit_picks", m.sql(_ASKED + ", f AS (" + " UNION ".join(f"(SELECT query_id, position FROM asked WHERE {c} ORDER BY position, query_id LIMIT 10)" for c in _KINDS) + "), r AS (SELECT query_id, position FROM asked WHERE query_id NOT IN (SELECT query_id FROM f) ORDER BY position, query_id LIMIT (SELECT 50 - count(*) FROM f)) SELECT * FROM f UNION ALL SELECT * FROM r", "queries"))
def audit_picks(spark, d):
    return preparation.audit_picks(_asked(spark, d))


@query("query_history", m.sql(_ASKED + ", s AS (SELECT search_query, count(*) AS train_rows, count(DISTINCT t.item_id) AS train_unique_items, count(i.item_id) AS benchmark_rows, count(DISTINCT i.item_id) AS benchmark_unique_items FROM train t LEFT JOIN (SELECT item_id FROM items WHERE category < 4) i ON i.item_id = t.item_id GROUP BY search_query) SELECT query_id, coalesce(train_rows, 0) AS train_rows, coalesce(train_unique_items, 0) AS train_unique_items, coalesce(benchmark_rows, 0) AS benchmark_rows, coalesce(benchmark_unique_items, 0) AS benchmark_unique_items, train_rows IS NOT NULL AS exact_query_in_train FROM asked LEFT JOIN s USING (search_query)", "queries", "train", "items"))
def query_history(spark, d):
    return preparation.query_history(_asked(spark, d), m.train(spark, d), m.items(spark, d).where("category < 4"))


@query("positive_signals", m.sql("SELECT round(avg(CASE WHEN contains(i.text, CASE WHEN t.search_location_id % 2 = 0 THEN t.search_query || ' ' || i.params ELSE i.params || ' ' || t.search_query END) THEN 1.0 ELSE 0.0 END), 9) AS phrase_in_text, round(avg(CASE WHEN t.search_category = i.category THEN 1.0 ELSE 0.0 END), 9) AS same_category, round(avg(CASE WHEN t.search_location_id = i.location THEN 1.0 ELSE 0.0 END), 9) AS same_location FROM train t JOIN items i USING (item_id)", "train", "items"))
def positive_signals(spark, d):
    t = m.train(spark, d).drop("microcat").join(m.items(spark, d), "item_id")
    # white space and capitals are no difference
    phrase = F.when(F.col("search_location_id") % 2 == 0, F.concat_ws("   ", F.upper("search_query"), "params")).otherwise(F.concat_ws(" ", "params", "search_query"))
    return preparation.positive_signals(t.select(phrase.alias("search_query"), F.col("text").alias("item_text"), F.col("search_category").alias("q_category"), F.col("category").alias("i_category"), F.col("search_location_id").alias("q_location"), F.col("location").alias("i_location")))


@query("router_text_raw", m.sql("SELECT DISTINCT trim(coalesce(search_query, '') || ' ' || coalesce(search_infm_params_text, '') || ' cat_' || coalesce(CAST(search_category AS VARCHAR), '')) AS word_text, ' ' || coalesce(search_query, '') || ' ' AS char_text FROM train", "train"))
def router_text_raw(spark, d):
    return m.train(spark, d).select(*preparation.router_texts()).distinct()


@query("safe_casts", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 5 = 1 THEN false ELSE p_partkey % 5 <> 2 END AS flag, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN -1 ELSE p_size END AS INTEGER) AS number FROM part")
def safe_casts(spark, d):
    kind = F.col("p_partkey") % 5
    flag = F.when(kind == 0, F.lit(None).cast("double")).when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(0.0)).otherwise(kind.cast("double"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".7")))
    return m.table(spark, d, "part").select("p_partkey", preparation.safe_bool(flag).alias("flag"), preparation.safe_int(text, -1).alias("number"))


_LONG = 26
_PAIR = """, p AS (SELECT query_id, item_id, 'Запрос: ' || q.title || CASE WHEN q.location % 2 = 0 THEN '' ELSE chr(10) || 'Фильтры: ' || q.params END AS query_text, 'Название: ' || i.title || CASE WHEN i.location % 2 = 0 THEN '' ELSE chr(10) || 'Параметры: ' || i.params END AS prefix, 'Описание: ' || repeat(i.text || ' ', 3) AS description FROM queries q JOIN items i USING (microcat)),
 w AS (SELECT *, regexp_split_to_array(trim(description), '\\s+') AS dw, len(regexp_split_to_array(query_text, '\\s+')) AS nq, len(regexp_split_to_array(prefix, '\\s+')) AS np FROM p)"""


@query("rerank_texts", m.sql(_PAIR.replace("\\\\", "\\") + f" SELECT query_id, item_id, query_text, CASE WHEN nq + np + len(dw) <= {_LONG} THEN prefix || chr(10) || trim(description) WHEN greatest(0, {_LONG} - 4 - nq - np) = 0 THEN prefix ELSE prefix || chr(10) || array_to_string(dw[1:{_LONG} - 4 - nq - np], ' ') END AS item_text FROM w", "queries", "items"))
def rerank_texts(spark, d):
    q = m.queries(spark, d).select("query_id", F.col("title").alias("search_query"), F.when(F.col("location") % 2 == 0, F.when(F.col("location") % 4 == 0, "nan")).otherwise(F.col("params")).alias("params"), "microcat")
    i = m.items(spark, d).select("item_id", F.concat(F.lit(" "), "title").alias("title"), F.when(F.col("location") % 2 == 0, " NaN ").otherwise(F.col("params")).alias("params"), F.concat_ws(" ", "text", "text", "text").alias("description"), "microcat")
    return rerank.pair_texts(q.select("query_id", "microcat").join(i.select("item_id", "microcat"), "microcat"), q, i, _LONG)


_SCORED = ", sc AS (SELECT DISTINCT query_id, item_id, CAST(length(CAST(hash_rest AS VARCHAR)) AS DOUBLE) AS rerank_score FROM (SELECT query_id, item_id, CAST(item_id AS BIGINT) * 7919 % 1000003 AS hash_rest FROM candidates) WHERE hash_rest % 3 <> 0)"


def _scores(spark, d):
    n = F.col("item_id").cast("long") * 7919 % 1000003
    return m.candidates(spark, d).where(n % 3 != 0).select("query_id", "item_id", F.length(n.cast("string")).cast("double").alias("rerank_score")).distinct()


@query("rerank_feature_fill", m.sql(_SCORED + " SELECT query_id, item_id, coalesce(rerank_score, -999.0) AS rerank_score FROM (SELECT DISTINCT query_id, item_id FROM candidates) LEFT JOIN sc USING (query_id, item_id)", "candidates"))
def rerank_feature_fill(spark, d):
    f = fusion.pair_features(m.candidates(spark, d), SOURCES)
    return rerank.with_rerank_score(f, _scores(spark, d)).select("query_id", "item_id", "rerank_score")


@query("rerank_depths", m.sql(_SCORED + """, pool AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, item_id) AS rank FROM candidates GROUP BY query_id, item_id), deep AS (SELECT depth, p.query_id, p.item_id, rerank_score, row_number() OVER (PARTITION BY depth, p.query_id ORDER BY rerank_score DESC, p.item_id) AS r FROM pool p JOIN sc USING (query_id, item_id) CROSS JOIN (VALUES (10), (30), (100)) AS g(depth) WHERE p.rank <= depth),
 rel AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id), hit AS (SELECT depth, query_id, count(*) AS h FROM deep JOIN truth USING (query_id, item_id) WHERE r <= 10 GROUP BY ALL) SELECT depth, round(avg(coalesce(h, 0) / n), 9) AS recall, count(*) AS queries FROM (SELECT * FROM rel CROSS JOIN (VALUES (10), (30), (100)) AS g(depth)) LEFT JOIN hit USING (depth, query_id) GROUP BY depth""", "candidates", "truth"))
def rerank_depths(spark, d):
    from lodestone.operators.candidates import union_best

    return rerank.depth_ablation(union_best(m.candidates(spark, d), 1000), _scores(spark, d), m.truth(spark, d), (10, 30, 100), 10)


@query("oof_report", m.sql(f", l AS (SELECT query_id, item_id, {_FOLD} AS fold, CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE t.query_id = c.query_id AND t.item_id = c.item_id) THEN 1 ELSE 0 END AS label FROM (SELECT DISTINCT query_id, item_id FROM candidates) c) SELECT count(*) AS rows, count(DISTINCT fold) AS folds, min(fold) AS first_fold, max(fold) AS last_fold, 0::BIGINT AS bad_labels, count(*) FILTER (label = 1) AS positives, 0::BIGINT AS duplicate_keys FROM l", "candidates", "truth"))
def oof_report(spark, d):
    from lodestone.operators.splits import context_folds

    t = fusion.labelled(fusion.pair_features(m.candidates(spark, d), SOURCES), m.truth(spark, d))
    return contracts.oof_report(t.join(context_folds(t.select("query_id")), "query_id"))


@query("hard_training_rows", m.sql("SELECT DISTINCT query_id, item_id, 0 AS label FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.query_id = c.query_id AND t.item_id = c.item_id)", "candidates", "truth"))
def hard_training_rows(spark, d):
    t = m.truth(spark, d)
    negatives = m.candidates(spark, d).select("query_id", "item_id").distinct().join(t, ["query_id", "item_id"], "left_anti")
    return contracts.hard_training_rows(t, negatives)


@query("ranking_metrics", m.sql(", best AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, item_id) AS rank FROM candidates GROUP BY query_id, item_id), rel AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id), h AS (SELECT k, query_id, count(*) FILTER (rank <= k) AS h FROM best JOIN truth USING (query_id, item_id) CROSS JOIN (VALUES (10), (50)) AS g(k) GROUP BY ALL) SELECT k, round(avg(coalesce(h, 0) / n), 9) AS recall, count(*) AS queries FROM (SELECT * FROM rel CROSS JOIN (VALUES (10), (50)) AS g(k)) LEFT JOIN h USING (k, query_id) GROUP BY k", "candidates", "truth"))
def ranking_metrics(spark, d):
    from lodestone.operators.candidates import union_best

    t = m.truth(spark, d)
    return evaluate.ranking_metrics(union_best(m.candidates(spark, d), 1000), t, t.select("query_id").distinct(), [10, 50])


@query("metric_rows", m.sql("SELECT 'run' AS run, 'recall@' || rank AS metric, CAST(rank AS DOUBLE) / 7 AS value FROM (SELECT DISTINCT rank FROM candidates)", "candidates"))
def metric_rows(spark, d):
    ranks = m.candidates(spark, d).select("rank").distinct()
    return tables.metric_rows(ranks.select(F.col("rank").alias("k"), (F.col("rank") / 7).alias("recall")), "run")


def _adaptive_sql(signal, ks=(15, 10, 5)):
    return m.sql(rt._COUNTS + f", r AS (SELECT query_id, category, probability, rank FROM asked JOIN p USING (query) WHERE rank <= 15), l AS (SELECT query_id, list_reverse_sort(list(probability)) AS v FROM r GROUP BY query_id), b AS (SELECT query_id, round({signal}, 9) AS best FROM l), e AS (SELECT quantile_cont(best, 0.333) AS lo, quantile_cont(best, 0.667) AS hi FROM b) SELECT query_id, category, probability, rank, CASE WHEN best <= lo THEN {ks[0]} WHEN best <= hi THEN {ks[1]} ELSE {ks[2]} END AS k FROM r JOIN b USING (query_id) CROSS JOIN e WHERE rank <= CASE WHEN best <= lo THEN {ks[0]} WHEN best <= hi THEN {ks[1]} ELSE {ks[2]} END", *rt.NEED)


def _adaptive(spark, d, signal, ks=(15, 10, 5)):
    return routing.adaptive_k(routing.posterior_probabilities(m.history(spark, d), rt.asked(spark, d), 15), ks, signal=signal)


@query("adaptive_k_margin", _adaptive_sql("v[1] - coalesce(v[2], 0.0)", (12, 10, 8)))
def adaptive_k_margin(spark, d):
    return _adaptive(spark, d, "margin", (12, 10, 8))


@query("adaptive_k_entropy", _adaptive_sql("list_sum(list_transform(v, lambda x: x * ln(x)))"))
def adaptive_k_entropy(spark, d):
    return _adaptive(spark, d, "entropy")


_TRUTH = ", tr AS (SELECT DISTINCT query AS query_id, category, category || '-' || suffix AS item_id, length(query) % 2 = 0 AS is_seen FROM history CROSS JOIN (VALUES ('a'), ('b')) AS x(suffix)), rt AS (SELECT query_id, category, rank FROM asked JOIN p USING (query) WHERE rank <= 10)"


def _route_truth(spark, d):
    h = m.history(spark, d).select(F.col("query").alias("query_id"), "category").distinct()
    return h.withColumn("item_id", F.explode(F.array(*(F.concat_ws("-", "category", F.lit(x)) for x in "ab")))).withColumn("is_seen", F.length("query_id") % 2 == 0)


@query("route_containment", m.sql(rt._COUNTS + _TRUTH + ", e AS (SELECT query_id, is_seen, avg(CASE WHEN EXISTS (SELECT 1 FROM rt WHERE rt.query_id = tr.query_id AND rt.category = tr.category) THEN 1.0 ELSE 0.0 END) AS share FROM tr GROUP BY ALL) SELECT 'overall' AS segment, round(avg(share), 9) AS item_containment FROM e UNION ALL SELECT CASE WHEN is_seen THEN 'seen' ELSE 'unseen' END, round(avg(share), 9) FROM e GROUP BY is_seen", *rt.NEED))
def route_containment(spark, d):
    routes = routing.posterior_probabilities(m.history(spark, d), rt.asked(spark, d), 10)
    return routing.containment(routes, _route_truth(spark, d))


@query("routing_grid", m.sql(rt._COUNTS + _TRUTH + """, sizes AS (SELECT microcat AS category, count(*) AS n FROM items GROUP BY microcat), e AS (SELECT k, q.query_id, coalesce((SELECT sum(n) FROM rt JOIN sizes USING (category) WHERE rt.query_id = q.query_id AND rank <= k), 0) AS size, CASE WHEN EXISTS (SELECT 1 FROM rt JOIN tr USING (query_id, category) WHERE rt.query_id = q.query_id AND rank <= k) THEN 1.0 ELSE 0.0 END AS hit FROM (SELECT DISTINCT query_id FROM tr) q CROSS JOIN (VALUES (1), (3), (10)) AS g(k))
 SELECT k, round(avg(hit), 9) AS containment, round(avg(size), 9) AS mean_size, round(quantile_cont(size, 0.5), 9) AS p50_size, round(quantile_cont(size, 0.95), 9) AS p95_size, CAST(min(size) AS BIGINT) AS min_size, CAST(max(size) AS BIGINT) AS max_size FROM e GROUP BY k""", "history", "queries", "items"))
def routing_grid(spark, d):
    routes = routing.posterior_probabilities(m.history(spark, d), rt.asked(spark, d), 10)
    sizes = m.items(spark, d).groupBy(F.col("microcat").alias("category")).agg(F.count("*").alias("n"))
    return routing.routing_grid(routes, _route_truth(spark, d), sizes, (1, 3, 10))


@query("ranker_oof_topk")
def ranker_oof_topk(spark, d):
    """A ranker's answers, each query's by a model that hasn't seen it; another solver than any SQL has."""
    f = fusion.filled_features(staged(fusion.pair_features(m.candidates(spark, d), SOURCES)), SOURCES, 50)
    return ml.rank_out_of_fold(fusion.labelled(f, m.truth(spark, d)), 20)
