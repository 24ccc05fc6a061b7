import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from lodestone.operators import contracts, preparation, rerank
from lodestone.operators.blocks import best_in_blocks


def test_texts_of_a_pair(spark):
    q = spark.createDataFrame([("a", " red phone ", "nan"), ("b", None, "new"), ("c", "", None)], "query_id string, search_query string, params string")
    i = spark.createDataFrame([("x", "phone", " NaN", "one two three four five six"), ("y", None, "p", None), ("z", None, None, "d")], "item_id string, title string, params string, description string")
    pool = q.select("query_id").crossJoin(i.select("item_id"))
    got = {(r.query_id, r.item_id): (r.query_text, r.item_text) for r in rerank.pair_texts(pool, q, i, 11).collect()}
    assert got["a", "x"] == ("Запрос: red phone", "Название: phone\nОписание: one")  # 11 - 4 - 3 - 2 words are left
    assert got["b", "x"] == ("Фильтры: new", "Название: phone\nОписание: one two three four five six")
    assert got["c", "y"] == ("", "Параметры: p") and got["c", "z"] == ("", "Описание: d")
    assert {r.item_text for r in rerank.pair_texts(pool.where("query_id = 'a' and item_id = 'x'"), q, i, 5).collect()} == {"Название: phone"}


def test_scores_are_kept_by_chunk(spark, tmp_path):
    pairs = spark.createDataFrame([(f"q{n}", f"i{n}", "red", "red phone") for n in range(20)], "query_id string, item_id string, query_text string, item_text string")
    folder = f"file://{tmp_path}/scores"
    first = rerank.score_pool(pairs, lambda q, i: [1.0] * len(q), folder, 4)
    assert first.count() == 20
    (tmp_path / "scores/chunk=2/_SUCCESS").unlink()  # as if its writer had been lost
    again = rerank.score_pool(pairs, lambda q, i: [2.0] * len(q), folder, 4)
    scores = {r.rerank_score for r in again.collect()}
    assert again.count() == 20 and scores == {1.0, 2.0}
    features = spark.createDataFrame([("q1", "i1"), ("q1", "other")], "query_id string, item_id string")
    assert {r.rerank_score for r in rerank.with_rerank_score(features, again).collect()} > {-999.0}


def test_raw_tables(spark):
    columns = "search_query string, search_location_id long, search_is_delivery_search int, search_infm_params_text string, search_category long"
    a = "a" * 16
    train = spark.createDataFrame([("x", 1, 0, "p", 2, a)], columns + ", item_id string")
    queries = spark.createDataFrame([("q" * 16, "x", 1, 0, "p", 2)], "query_id string, " + columns)
    items = spark.createDataFrame([(a,)], "item_id string")
    assert preparation.validate_raw(train, queries, items)["train_rows"] == 1
    for bad in ((train.limit(0), queries, items), (train, queries.unionByName(queries), items), (train, queries, items.withColumn("item_id", F.lit("short"))), (train.withColumn("search_is_delivery_search", F.lit(2)), queries, items), (train.drop("search_query"), queries, items)):
        with pytest.raises(contracts.SchemaError):
            preparation.validate_raw(*bad)


def test_pairs_of_unknown_items_are_refused(spark):
    q, i = (spark.createDataFrame([("a", "t")], f"{key} string, text string") for key in ("query_id", "item_id"))
    pairs = spark.createDataFrame([("a", "a"), ("a", "b")], "query_id string, item_id string")
    with pytest.raises(contracts.SchemaError):
        preparation.training_pairs(pairs, q, i)
    assert rows(preparation.training_pairs(pairs.limit(1), q, i)) == [("a", "a", "t", "t")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 3))
def test_best_in_blocks(spark, seed, k, parts):
    """Sparse and dense products, with and without routes, against all pairs."""
    import numpy as np

    r = np.random.default_rng(seed)
    x, y = (r.integers(-2, 3, (n, 6)).astype(float) for n in (30, 9))
    route = [f"r{j}" for j in r.integers(0, 4, 30)]
    allowed = [[f"r{j}" for j in np.flatnonzero(r.random(4) < 0.5)] for _ in range(9)]

    def frame(kind):
        def vector(v):
            return ([int(j) for j in np.flatnonzero(v)], [float(z) for z in v[v != 0]]) if kind == "sparse" else ([float(z) for z in v],)

        names = "terms array<long>, weights array<double>" if kind == "sparse" else "v array<double>"
        items = spark.createDataFrame([(f"i{n:02d}", *vector(v), route[n]) for n, v in enumerate(x)], f"item_id string, {names}, route string")
        asked = spark.createDataFrame([(n, *vector(v), allowed[n]) for n, v in enumerate(y)], f"query_id long, {names}, routes array<string>")
        return items.repartition(3), asked

    def best(n, kind, may):
        scored = [(-float(x[i] @ y[n]), f"i{i:02d}") for i in range(30) if may(route[i]) and (kind == "dense" or x[i] @ y[n] > 0)]
        return [(n, i, -s) for s, i in sorted(scored)[:k]]

    from lodestone.operators.candidates import top_k

    for kind in ("sparse", "dense"):
        items, asked = frame(kind)
        plain = top_k(best_in_blocks(items.drop("route"), asked.drop("routes"), k, parts=parts).drop("block"), k)
        assert rows(plain, "query_id", "item_id", "score") == sorted((z for n in range(9) for z in best(n, kind, lambda _: True)), key=repr)
        both = top_k(best_in_blocks(items, asked, k, k, parts), k, by=("query_id", "block"))
        assert rows(both.where("block = 1"), "query_id", "item_id", "score") == sorted((z for n in range(9) for z in best(n, kind, lambda a, n=n: a in allowed[n])), key=repr)
        assert rows(both.where("block = 2"), "query_id", "item_id", "score") == sorted((z for n in range(9) for z in best(n, kind, lambda a, n=n: a not in allowed[n])), key=repr)
