import re

import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from lodestone.operators import blocks, dense, evaluate, lexical, ranking, routing
from lodestone.plans import dense_queries

ITEMS = "item_id string, text string"


def ranked(df, query="q"):
    return [r.item_id for r in df.where(f"query_id = '{query}'").orderBy("rank").collect()]


def test_bm25_without_a_match_pads(spark):
    items = spark.createDataFrame([("b", "red phone"), ("a", "blue car")], ITEMS)
    out = lexical.bm25(items, spark.createDataFrame([("q", "boat"), ("e", "")], "query_id string, text string"), 2)
    assert rows(out, "query_id", "item_id", "score") == [("q", "a", 0.0), ("q", "b", 0.0)]


def test_bm25_category_policies(spark):
    items = spark.createDataFrame([("a", "red phone", "phone"), ("b", "red car", "car"), ("c", "blue phone", "phone")], ITEMS + ", category string")
    queries = spark.createDataFrame([("q1", "red", "phone"), ("q2", "red", None)], "query_id string, text string, category string")
    hard = lexical.bm25_by_category(items, queries, 3, "hard")
    assert (set(ranked(hard, "q1")), ranked(hard, "q2")) == ({"a", "c"}, [])
    assert set(ranked(lexical.bm25_by_category(items, queries, 3, "fallback"), "q2")) == {"a", "b", "c"}


def test_routed_only_allowed_items(spark):
    items = spark.createDataFrame([("car", "iphone car", "r1"), ("bike", "bike", "r1"), ("phone", "iphone", "r2")], ITEMS + ", route string")
    q = spark.createDataFrame([("q", "iphone"), ("n", "iphone")], "query_id string, text string")
    allowed = spark.createDataFrame([("q", "r1")], "query_id string, route string")
    out = lexical.tfidf_routed(items, q, allowed, 3)
    assert (ranked(out), ranked(out, "n")) == (["car", "bike"], [])


def test_fallback_is_appended(spark):
    items = spark.createDataFrame([("item_1", "bike", "r1"), ("item_2", "iphone", "r2"), ("item_3", "iphone case", "r2"), ("item_4", "boat", "r2")], ITEMS + ", route string")
    q = spark.createDataFrame([("q", "iphone")], "query_id string, text string")
    out = lexical.tfidf_routed(items, q, spark.createDataFrame([("q", "r1")], "query_id string, route string"), 1, fallback_k=2)
    assert ranked(out) == ["item_1", "item_2", "item_3"]


def test_zero_ties_by_id(spark):
    items = spark.createDataFrame([(f"item_{c}", "x") for c in "zmac"], ITEMS)
    q = spark.createDataFrame([("q", "unrelated")], "query_id string, text string")
    assert ranked(lexical.tfidf(items, q, 3)) == ["item_a", "item_c", "item_m"]


def test_empty_filter_branch(spark):
    items = spark.createDataFrame([("a", "red phone", "", "new")], "item_id string, title string, description string, params string")
    q = spark.createDataFrame([("q1", "new"), ("q2", "")], "query_id string, text string")
    out = lexical.field_branch(items, q, "D", 5)
    assert (ranked(out, "q1"), ranked(out, "q2")) == (["a"], [])


def test_numeric_overlap(spark):
    items = spark.createDataFrame([("a", "iphone 12 128 гб"), ("b", "iphone 12"), ("c", "none")], ITEMS)
    q = spark.createDataFrame([("q", "12 128gb"), ("w", "words")], "query_id string, text string")
    assert rows(lexical.numeric_overlap(items, q, 5), "query_id", "item_id", "score") == [("q", "a", 1.0), ("q", "b", 0.5)]


def test_dense_equals_full_sort(spark):
    r = np.random.default_rng(3)
    x, y = r.integers(-2, 3, (40, 4)).astype(float), r.integers(-2, 3, (7, 4)).astype(float)
    items = spark.createDataFrame([(f"i{k:02d}", v.tolist()) for k, v in enumerate(x)], "item_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(y)], "query_id string, embedding array<double>")
    out = dense.exact_top_k(items, q, 5)
    for k in range(7):
        s = x @ y[k]
        assert ranked(out, f"q{k}") == [f"i{j:02d}" for j in sorted(range(40), key=lambda j: (-s[j], j))[:5]]


def test_dense_fallback_reranks(spark):
    items = spark.createDataFrame([(f"item_{c}", [1.0, 0.0], f"r{c}") for c in "cab"], "item_id string, embedding array<double>, route string")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    out = dense.routed_top_k(items, q, spark.createDataFrame([("q", "rc")], "query_id string, route string"), 1, 3)
    assert ranked(out) == ["item_a", "item_b", "item_c"]


def test_posterior(spark):
    data = [("car", "cat_10")] * 2 + [("car", "cat_20")] * 2 + [("phone", "cat_1")] * 3 + [("phone", "cat_2")]
    h = spark.createDataFrame([*data, (None, "cat_9"), ("x", None)], "query string, category string")
    q = spark.createDataFrame([("q1", "car"), ("q2", "phone"), ("q3", "boat")], "query_id string, query string")
    top = routing.posterior_top_k(h, q, 4)
    got = {k: [r.category for r in top.where(f"query_id = '{k}'").orderBy("rank").collect()] for k in ("q1", "q3")}
    assert got == {"q1": ["cat_10", "cat_20"], "q3": ["cat_1", "cat_10", "cat_20", "cat_2"]}
    assert rows(routing.posterior_probabilities(h, q).where("query_id = 'q2'"), "category", "probability") == [("cat_1", 0.75), ("cat_2", 0.25)]


def test_routing_percentiles(spark):
    sizes = spark.createDataFrame([(f"c{i:02d}", i + 1) for i in range(20)], "category string, n long")
    routes = spark.createDataFrame([(f"q{i}", f"c{i:02d}") for i in range(20)], "query_id string, category string")
    truth = spark.createDataFrame([(f"q{i}", f"c{i:02d}" if i % 2 else "none", True) for i in range(20)], "query_id string, category string, is_seen boolean")
    r = routing.evaluate(routes, truth, sizes).where("segment = 'overall'").first()
    assert (r.category_hit, r.median_size, r.p95_size, r.max_size) == (0.5, 11, 20, 20)


def test_cascade_prefers_the_same_place(spark):
    c = spark.createDataFrame([("q", "far", 1.0), ("q", "here", 0.5), ("q", "other", 9.0), ("q", "unknown", 1.0)], "query_id string, item_id string, score double")
    q = spark.createDataFrame([("q", 7, 3)], "query_id string, location long, category long")
    i = spark.createDataFrame([("far", 8, 3, 10.0, 10.0), ("here", 7, 3, 0.0, 0.0), ("other", 7, 4, 1.0, 1.0), ("unknown", 9, 3, 0.0, 5.0)], "item_id string, location long, category long, lat double, lon double")
    centroids = spark.createDataFrame([(7, 10.0, 10.1)], "location long, lat double, lon double")
    out = ranking.geo_cascade(ranking.with_places(c, q, i, centroids)).orderBy("rank").collect()
    assert [r.item_id for r in out] == ["here", "far", "other", "unknown"]
    assert out[0].final_score == 15.0 and out[3].final_score == 0.05


def test_exact_length(spark):
    r = spark.createDataFrame([("q", "m", 1)], "query_id string, item_id string, rank int")
    corpus = spark.createDataFrame([("m", 0), ("z", 1), ("a", 2)], "item_id string, position long")
    assert ranked(ranking.fill_exactly(r, r.select("query_id"), corpus, 3)) == ["m", "z", "a"]


def meeting(monkeypatch):
    """How many items and queries have met in blocks, and in how many parts."""
    seen, meet = [], blocks.best_in_blocks

    def counted(items, queries, k, outside_k=0, parts=1):
        seen.append((items.count(), queries.count(), parts))
        return meet(items, queries, k, outside_k, parts)

    monkeypatch.setattr(blocks, "best_in_blocks", counted)
    return seen


def test_many_queries_of_equal_texts_meet_once(spark, monkeypatch):
    texts = ["red car", "blue car", "red phone", "old boat", "new bike"]
    items = spark.createDataFrame([(f"i{n:02d}", texts[n % 5]) for n in range(40)], ITEMS)
    queries = spark.createDataFrame([(f"q{n:02d}", ["red", "car blue", "nothing", "boat boat red"][n % 4]) for n in range(16)], "query_id string, text string")
    want = rows(lexical.top_k(lexical.bm25_scores(items, queries, 12), 12), "query_id", "item_id", "score", "rank")
    monkeypatch.setattr(blocks, "ASKING", 2)
    seen = meeting(monkeypatch)
    assert rows(lexical.bm25_of_many(items, queries, 12), "query_id", "item_id", "score", "rank") == want
    assert seen == [(5, 4, 2)] and {r[0] for r in want} == {f"q{n:02d}" for n in range(16) if n % 4 != 2}


def test_best_adds_what_rounds_to_more():
    best = blocks.Best(1, 1, 0.0)
    best.add(np.array([[0.0, 4e-10, 6e-10]]), None, 0)
    assert [x.tolist() for x in best.compact()] == [[0], [2], [1e-9]]
    best.add(np.array([[1.4e-9, 1.6e-9]]), None, 3)
    assert [x.tolist() for x in best.compact()] == [[0], [4], [2e-9]]


def test_numbers_of_equal_texts_meet_once(spark, monkeypatch):
    items = spark.createDataFrame([(f"i{n:02d}", ["12 128 гб", "128gb, 12", "12", "none"][n % 4]) for n in range(24)], ITEMS)
    queries = spark.createDataFrame([(f"q{n}", ["12 7", "7 128gb 12"][n % 2]) for n in range(8)], "query_id string, text string")
    seen = meeting(monkeypatch)
    out = rows(lexical.numeric_overlap(items, queries, 14), "query_id", "item_id", "score", "rank")
    both, one = ([f"i{n:02d}" for n in range(24) if n % 4 in x] for x in ((0, 1), (2,)))
    tied = sorted(both + one)[:14]
    want = [(f"q{n}", i, round(s, 9), r) for n in range(8) for r, (i, s) in enumerate(([(i, 0.5) for i in tied], [(i, 2 / 3) for i in both] + [(i, 1 / 3) for i in one[:2]])[n % 2], 1)]
    assert out == sorted(want)
    assert seen == [(2, 2, 1)]


def test_recall_of_shared_labels_without_pairs(spark):
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 3), ("e", None), ("f", 1), ("f", 1)], "id string, label int")
    found = spark.createDataFrame([("a", "b", 1), ("a", "a", 2), ("a", "c", 3), ("b", "c", 1), ("b", "f", 2), ("c", "e", 1), ("d", "a", 1), ("f", "a", 2)], "query_id string, item_id string, rank int")
    other = labels.select(F.col("id").alias("item_id"), "label")
    pairs = labels.withColumnRenamed("id", "query_id").join(other, "label").where("query_id <> item_id")
    assert rows(evaluate.same_label_recall(found, labels, (1, 3)), "k", "recall", "queries") == rows(evaluate.recall_at(found, pairs, (1, 3)), "k", "recall", "queries")


def test_dense_recall_makes_no_rows_of_pairs(spark, tmp_path):
    n = 300
    frame = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = dense_queries.dense_recall(spark, str(tmp_path))
    assert rows(out, "k", "recall", "queries") == sorted([(k, round(k / (n - 1), 9), n) for k in (5, 10, 20)], key=repr)
    assert not re.search(r"Join.*label#\d+ = route#", out._jdf.queryExecution().optimizedPlan().toString())
