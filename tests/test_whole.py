import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.operators import ml, routing
from lodestone.plans import champion
from lodestone.plans import mapping as m

SF = "/root/testdata/sf0.001"


def test_champion_answer_runs_at_full_depth(spark, monkeypatch):
    called, real = {}, champion.champion
    monkeypatch.setattr(champion, "champion", lambda *a, **b: called.update(inspect.signature(real).bind(*a, **b).arguments) or real(*a, **b))
    out = __spark_entry__.queries()["champion_answer"](spark, SF)
    assert (called.get("d") or champion.Depths()) == champion.Depths() and called.get("classifier", True)
    assert {r["count"] for r in out.groupBy("query_id").count().collect()} == {champion.Depths().answer}


def test_router_classifier_reads_parts_of_words(spark):
    train = spark.createDataFrame([("telephone", "z")] * 3 + [("bicycle", "a")] * 3, "text string, category string")
    out = routing.classifier_routes(train, spark.createDataFrame([("q", "telephones"), ("e", "")], "query_id string, text string"), 2)
    assert out.where("query_id = 'q' and rank = 1").first().category == "z" and out.where("query_id = 'e'").count() == 2


def test_router_classifier_runs_at_its_defaults(spark, monkeypatch):
    given = []
    monkeypatch.setattr(routing, "classifier_routes", lambda train, queries, k, **more: given.append(more) or queries)
    __spark_entry__.queries()["router_classifier_topk"](spark, SF)
    monkeypatch.setattr(routing, "hybrid", lambda history, queries, *a, **b: spark.createDataFrame([("q", "c")], "query_id string, category string"))
    champion.routes_for(spark.createDataFrame([("a", 1)], "search_query string, microcat int"), spark.createDataFrame([("q", "b")], "query_id string, search_query string"), 2)
    assert given == [{}, {}]


def test_towers_train_token_vectors_and_on_hard_negatives():
    model = ml.TwoTower(vocabulary=512, width=16, dimension=16)
    before = model.weights["tokens"].copy()
    ml.train_two_tower(model, [(f"word{i}", f"word{i} thing") for i in range(30)], epochs=3, batch=30)
    assert not np.allclose(before, model.weights["tokens"])
    losses = ml.train_two_tower_with_hard_negatives(model, [(f"word{i}", f"word{i} thing", [f"word{j} thing" for j in range(i)]) for i in range(1, 9)], epochs=30, batch=8)
    assert losses[-1] < losses[0]


@pytest.mark.parametrize("hard", [False, True])
def test_steps_follow_the_gradient(hard):
    rows = [("a b", "c d", ["e f", "g"]), ("b", "h a", ["c d"])]
    train = lambda model, rate: (ml.train_two_tower_with_hard_negatives(model, rows, rate=rate, temperature=0.5) if hard else ml.train_two_tower(model, [r[:2] for r in rows], epochs=1, rate=rate, temperature=0.5))[0]
    for name in ("tokens", "query", "item"):
        model = ml.TwoTower(vocabulary=20, width=3, dimension=3)
        start = model.weights[name].copy()
        train(model, 1.0)
        gradient, numeric = start - model.weights[name], np.zeros_like(start)
        for at in np.ndindex(start.shape):
            ends = []
            for h in (1e-6, -1e-6):
                model = ml.TwoTower(vocabulary=20, width=3, dimension=3)
                model.weights[name][at] += h
                ends.append(train(model, 0.0))
            numeric[at] = (ends[0] - ends[1]) / 2e-6
        assert np.allclose(gradient, numeric, atol=1e-5)


def test_two_tower_topk_is_trained(spark):
    titles = {r.item_id: r.title for r in m.items(spark, SF).collect()}
    asked = {r.query_id: r.title for r in m.queries(spark, SF).collect()}
    out = __spark_entry__.queries()["two_tower_topk"](spark, SF).where("rank = 1").collect()
    bought = [r for r in out if asked[r.query_id] in titles.values()]
    assert sum(titles[r.item_id] == asked[r.query_id] for r in bought) > 0.9 * len(bought)


def test_selected_ranks_every_query_by_a_model_that_did_not_see_it(spark, monkeypatch):
    ids = lambda t: {r.query_id for r in t.select("query_id").distinct().collect()}
    ranked, size = [], []

    def train(table, features=None, trees=20, depth=4, seed=42):
        size.append((trees, depth))
        return ids(table)

    monkeypatch.setattr(ml, "train_selector", train)
    monkeypatch.setattr(ml, "rank_with_selector", lambda seen, table, limit=50: ranked.append((seen, ids(table))) or table.withColumns({"final_score": F.lit(0.0), "rank": F.lit(1)}))
    every = {f"q{i:02d}" for i in range(30)}
    c = spark.createDataFrame([(q, "a", "A", 1.0, 1) for q in every], "query_id string, item_id string, source string, score double, rank int")
    champion.selected(c, c.select("query_id", "item_id"), ("A",))
    assert not any(seen & asked for seen, asked in ranked) and sorted(q for _, asked in ranked for q in asked) == sorted(every)
    __spark_entry__.queries()["selector_gbt_topk"](spark, SF)
    assert set(size) == {(20, 4)}


def test_equal_rows_train_as_one_of_their_weight(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x = F.col("id") % 12
    table = spark.range(600).select(F.col("id").cast("string").alias("query_id"), x.cast("double").alias("a"), (x * x % 7).alias("b"), ((x * x % 5 + F.col("id") % 3) > 3).cast("int").alias("label"))
    plain = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), GBTClassifier(maxIter=5, maxDepth=3, seed=42)]).fit(table.withColumn("label", F.col("label").cast("double")))
    seen, rows_of = [], ml.distinct_instances
    monkeypatch.setattr(ml, "distinct_instances", lambda t, names: seen.append(rows_of(t, names)) or seen[-1])
    model = ml.train_selector(table, ["a", "b"], 5, 3)
    scores = [{r.query_id: r.final_score for r in ml.score_selector(one, table).collect()} for one in (plain, model)]
    assert all(abs(scores[0][q] - s) < 1e-8 for q, s in scores[1].items()) and len(set(scores[0].values())) > 2
    assert (seen[0].count(), seen[0].agg(F.sum("__times")).first()[0]) == (table.select("a", "b", "label").distinct().count(), 600.0)
    assert not seen[0].is_cached


def test_features_are_made_once_for_all_folds(spark):
    scanned = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(v):
        scanned.add(1)
        return v

    table = spark.range(60).select((F.col("id") % 20).cast("string").alias("query_id"), F.col("id").cast("string").alias("item_id"), (F.col("id") % 2).cast("int").alias("label"), slow((F.col("id") % 7).cast("double")).alias("x"))
    out = ml.rank_out_of_fold(table, 2, folds=2, trees=1, depth=2)
    assert out.groupBy("query_id").count().where("count = 2").count() == 20 and out.columns == ["query_id", "item_id", "fold", "final_score", "rank"]
    assert scanned.value == 60


def test_selected_makes_its_features_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(v):
        made.add(1)
        return v

    monkeypatch.setattr(ml, "train_selector", lambda table, features=None: table.count())
    monkeypatch.setattr(ml, "rank_with_selector", lambda seen, table, limit=50: table.withColumns({"final_score": F.lit(0.0), "rank": F.lit(1)}))
    c = spark.range(40).select(F.col("id").cast("string").alias("query_id"), F.lit("a").alias("item_id"), F.lit("A").alias("source"), slow(F.col("id").cast("double")).alias("score"), F.lit(1).alias("rank"))
    truth = spark.createDataFrame([("1", "a")], "query_id string, item_id string")
    assert champion.selected(c, truth, ("A",)).count() == 40
    assert made.value == 40
