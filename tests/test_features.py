import pytest
from pyspark.sql import functions as F

from lodestone.operators import features, fusion

PLACED = "query_id string, item_id string, score double, rank int, q_category long, q_location long, i_category long, i_location long, distance_km double"
ROWS = [("q", "a", 0.5, 1, 0, 7, 3, 7, 4.0), ("q", "b", 0.25, 2, 0, 7, 4, 8, 30.0), ("q", "c", 0.25, 3, 0, 7, None, None, None), ("r", "a", 0.1, 1, 3, None, 3, 7, None)]


@pytest.fixture
def parts(spark):
    branches = spark.createDataFrame([("q", "a", "x", 9.0, 1), ("q", "b", "x", 8.0, 2), ("q", "b", "y", 3.0, 1), ("q", "c", "y", 2.0, 40), ("q", "a", "z", 1.0, 1)], "query_id string, item_id string, source string, score double, rank int")
    routes = spark.createDataFrame([("q", "m1", 1), ("q", "m2", 4), ("q", "m2", 2)], "query_id string, category string, rank int")
    queries = spark.createDataFrame([("q", "Red  red\tlamp", 1), ("r", None, None)], "query_id string, query_text string, q_delivery int")
    items = spark.createDataFrame([("a", "red Lamp big", "m1"), ("b", None, "m2"), ("c", "", None)], "item_id string, item_text string, i_route string")
    return spark.createDataFrame(ROWS, PLACED), branches, routes, queries, items


def test_analytic_features(parts):
    placed, branches, routes, queries, items = parts
    out = {(r.query_id, r.item_id): r for r in features.analytic_features(placed, branches, ("x", "y"), routes, queries, items, depth=20).collect()}
    assert len(out) == 4
    a, b, c, r = out["q", "a"], out["q", "b"], out["q", "c"], out["r", "a"]
    assert (a.x_score, a.x_inverse_rank, a.in_x, a.in_y, a.source_count) == (9.0, 0.5, 1, 0, 1) and b.source_count == 2
    assert (c.y_score, c.in_y, c.source_count) == (0.0, 0, 0) and c.y_inverse_rank == pytest.approx(1 / 22)
    assert [x.route_rank for x in (a, b, c, r)] == [0, 1, -1, -1] and (a.first_route, b.first_route, b.early_route, c.early_route) == (1, 0, 1, 0)
    assert (a.shared_words, a.query_words) == (2, 2) and a.word_jaccard == pytest.approx(2 / 3) and (b.shared_words, b.word_jaccard, r.query_words, r.word_jaccard) == (0, 0.0, 0, 0.0)
    assert (a.same_location, a.delivery_same, a.delivery_distance, r.q_delivery) == (1, 1, 4.0, 0) and (c.distance_km, c.distance_missing, c.same_location, c.same_category) == (500.0, 1, 0, 0)
    assert (a.same_category, a.any_category, a.valid_category, r.same_category, r.any_category, r.same_location) == (0, 1, 1, 1, 0, 0)
    assert r.score_z == 0.0 and a.score_diff == 0.0 and a.score_norm == pytest.approx(1, abs=1e-5) and a.score_z > 0


def test_cascade_features(parts):
    placed, _, routes, queries, items = parts
    out = {(r.query_id, r.item_id): r for r in features.cascade_features(placed, routes, queries, items).collect()}
    a, b, c, r = out["q", "a"], out["q", "b"], out["q", "c"], out["r", "a"]
    assert [x.geo_tier for x in (a, b, c, r)] == [1, 2, 4, 4] and (a.distance_km, b.distance_km, c.distance_km) == (0.0, 30.0, 500.0)
    assert a.cascade_score == 15.0 and c.cascade_score == 0.0125 and [x.route_rank for x in (a, b, c)] == [1, 2, -1]
    assert (a.cascade_diff, r.cascade_z, r.fused_score, r.valid_category) == (0.0, 0.0, 0.1, 1) and a.cascade_norm == pytest.approx(1)


def test_features_of_empty_lists(parts):
    placed, branches, routes, queries, items = (x.where("false") for x in parts)
    assert features.analytic_features(placed, branches, ("x",), routes, queries, items).count() == 0
    assert features.cascade_features(placed, routes, queries, items).count() == 0
    kept = features.analytic_features(parts[0], branches, ("x",), routes, queries, items)
    assert kept.agg(F.count("*"), F.max("source_count"), F.max("route_rank"), F.max("query_words")).first()[:] == (4, 0, -1, 0)


def test_fixed_floors(parts):
    pairs = fusion.pair_features(parts[1], ("x", "y"))
    out = {r.item_id: r for r in fusion.filled_features(pairs, ("x", "y"), 500, {"x": -0.25}).collect()}
    assert (out["c"].x_score, out["c"].x_rank, out["a"].y_score, out["a"].y_rank) == (-0.25, 501, -100.0, 501) and out["b"].y_score == 3.0
