"""Interactions, splits, folds and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import candidates as cand
from lodestone.operators import contracts, splits
from lodestone.plans import mapping as m
from lodestone.plans.registry import query

_N = "CAST(concat('0x', substr(sha256('{seed}:' || {key}), 1, 16)) AS UBIGINT)"
_U = "CAST(" + _N + " AS DOUBLE) / 18446744073709551616.0"
_SPLIT = "SELECT item_id, CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < 0.9 THEN 'validation' ELSE 'test' END AS split FROM items".format(u=_U.format(seed=42, key="item_id"))
_FOLD = f"CAST({_N.format(seed=42, key='query_id')} % 5 AS INTEGER)"


@query("distinct_interactions", m.sql("SELECT DISTINCT query_id, item_id, 1 AS label FROM interactions", "interactions"))
def distinct_interactions(spark, d):
    return splits.distinct_interactions(m.interactions(spark, d))


@query("dedup_item_snapshots", "SELECT CAST(l_partkey AS VARCHAR) AS item_id, l_extendedprice AS price, l_quantity AS quantity, l_suppkey AS seller FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice NULLS LAST, l_quantity NULLS LAST, l_suppkey NULLS LAST) = 1")
def dedup_item_snapshots(spark, d):
    return splits.dedup_items(m.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("item_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_suppkey").alias("seller")))


@query("hash_split_items", m.sql(_SPLIT, "items"))
def hash_split_items(spark, d):
    return splits.item_splits(m.items(spark, d))


@query("ground_truth_join", m.sql(f", s AS ({_SPLIT}) SELECT DISTINCT split, query_id, item_id FROM interactions JOIN s USING (item_id)", "items", "interactions"))
def ground_truth_join(spark, d):
    return splits.ground_truth(m.interactions(spark, d), splits.item_splits(m.items(spark, d)), strict=False)


@query("query_slices", m.sql(f", s AS ({_SPLIT}) SELECT split, query_id, count(DISTINCT item_id) AS relevant_count, count(DISTINCT item_id) > 1 AS is_multi_positive FROM interactions JOIN s USING (item_id) GROUP BY split, query_id", "items", "interactions"))
def query_slices(spark, d):
    return splits.query_slices(splits.ground_truth(m.interactions(spark, d), splits.item_splits(m.items(spark, d)), strict=False))


@query("context_folds", m.sql(f"SELECT DISTINCT query_id, {_FOLD} AS fold FROM interactions", "interactions"))
def context_folds(spark, d):
    return splits.context_folds(m.interactions(spark, d))


_CORPUS = "SELECT item_id FROM items WHERE category < 4"


@query("context_holdout", m.sql(f", p AS (SELECT DISTINCT query_id, item_id FROM interactions WHERE item_id IN ({_CORPUS})) SELECT query_id, item_id, {_FOLD} AS fold, CASE WHEN {_FOLD} = 0 THEN 'train' ELSE 'validation' END AS part, count(*) OVER (PARTITION BY query_id) AS known_positives FROM p", "items", "interactions"))
def context_holdout(spark, d):
    return splits.context_holdout(m.interactions(spark, d), m.items(spark, d).where("category < 4"))


@query("context_holdout_four_folds", m.sql(f", p AS (SELECT DISTINCT query_id, item_id FROM interactions) SELECT CASE WHEN {_FOLD} <> 0 THEN 'train' ELSE 'validation' END AS part, count(*) AS pairs, count(DISTINCT query_id) AS queries FROM p GROUP BY 1", "interactions"))
def context_holdout_four_folds(spark, d):
    held = splits.context_holdout(m.interactions(spark, d), m.items(spark, d), single_fold=False)
    return held.groupBy("part").agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries"))


@query("strict_unseen_split", m.sql(f"SELECT part, count(*) AS n, count(DISTINCT search_query) AS texts FROM (SELECT search_query, CASE WHEN {_N.format(seed=42, key='search_query')} % 5 = 0 THEN 'unseen' ELSE 'seen' END AS part FROM train) GROUP BY part", "train"))
def strict_unseen_split(spark, d):
    return splits.strict_unseen(m.train(spark, d), "search_query").groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("search_query").alias("texts"))


@query("contract_report", m.sql("SELECT (SELECT count(*) FROM items) AS rows, (SELECT count(*) FROM items WHERE item_id IS NULL OR length(item_id) <> 16) AS item_id_bad, (SELECT count(*) FROM (SELECT item_id FROM items GROUP BY item_id HAVING count(*) > 1)) AS duplicate_keys", "items"))
def contract_report(spark, d):
    return contracts.TableContract(("item_id", "title"), ("item_id",), ("item_id",)).report(m.items(spark, d))


@query("domain_report", "SELECT count(*) FILTER (n_chars IS NOT NULL AND try_cast(n_chars AS DOUBLE) IS NULL) AS n_chars_invalid, count(*) FILTER (lang IS NOT NULL AND try_cast(lang AS DOUBLE) IS NULL) AS lang_invalid FROM documents")
def domain_report(spark, d):
    return contracts.domain_report(m.table(spark, d, "documents"), ["n_chars", "lang"])


@query("flag_report", "SELECT count(*) FILTER (quality IS NOT NULL AND quality NOT IN (0, 1)) AS quality_not_binary, count(*) FILTER (toxic IS NOT NULL AND toxic NOT IN (0, 1)) AS toxic_not_binary FROM labels")
def flag_report(spark, d):
    return contracts.domain_report(m.table(spark, d, "labels"), [], ["quality", "toxic"])


@query("candidate_contract_report", m.sql("""SELECT (SELECT count(*) FROM candidates) AS rows, (SELECT count(*) FROM candidates WHERE score IS NULL OR isnan(score) OR isinf(score)) AS bad_scores, (SELECT count(*) FROM candidates WHERE rank IS NULL OR rank < 1) AS bad_ranks,
 (SELECT count(*) FROM (SELECT 1 FROM candidates GROUP BY query_id, item_id, source HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM candidates WHERE item_id NOT IN (SELECT item_id FROM items)) AS unknown_items,
 (SELECT count(*) FROM (SELECT 1 FROM candidates GROUP BY query_id, source HAVING count(*) <> max(rank) OR count(*) <> count(DISTINCT rank))) AS groups_with_gaps""", "items", "candidates"))
def candidate_contract_report(spark, d):
    return contracts.candidate_report(m.candidates(spark, d), m.items(spark, d))


HARD = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, rank, item_id) AS sampling_order FROM (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.query_id = c.query_id AND t.item_id = c.item_id)
 QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY source, rank) = 1) QUALIFY sampling_order <= 20"""


@query("hard_negatives", m.sql(HARD, "candidates", "truth"))
def hard_negatives(spark, d):
    return cand.hard_negatives(m.candidates(spark, d), m.truth(spark, d))


@query("negative_report", m.sql(f", n AS ({HARD}) SELECT (SELECT count(*) FROM (SELECT 1 FROM n GROUP BY query_id, item_id HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM n JOIN truth USING (query_id, item_id)) AS positives, (SELECT count(*) FROM (SELECT 1 FROM n GROUP BY query_id HAVING count(*) > 20)) AS queries_over_cap, (SELECT count(*) FROM n WHERE item_id NOT IN (SELECT item_id FROM items)) AS unknown_items", "items", "candidates", "truth"))
def negative_report(spark, d):
    t = m.truth(spark, d)
    return contracts.negatives_report(cand.hard_negatives(m.candidates(spark, d), t), t, m.items(spark, d).select("item_id"), 20)
