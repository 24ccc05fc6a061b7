import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import rows
from lodestone.operators import candidates as cand
from lodestone.operators import contracts, evaluate, fusion

SCHEMA = "query_id string, item_id string, source string, score double, rank int"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def truth(spark, pairs):
    return spark.createDataFrame(pairs, "query_id string, item_id string")


def test_ties_across_sources(spark):
    """Equal scores of three sources: each pair counts once, the smaller id is first, and null scores are last."""
    c = frame(spark, [("k", "m3", "s", 7.5, 1), ("k", "m1", "t", 7.5, 1), ("k", "m2", "u", 7.5, 1), ("k", "m1", "u", 2.0, 2), ("k", "m0", "s", None, 2), ("n", "m9", "s", -1.0, 1)])
    assert rows(cand.rank_candidates(c, limit=3), "query_id", "item_id", "rank") == [("k", "m1", 1), ("k", "m2", 2), ("k", "m3", 3), ("n", "m9", 1)]
    assert rows(cand.rank_candidates(c, limit=9).where("query_id = 'k'"), "rank", "item_id")[-1] == (4, "m0")


@pytest.mark.parametrize("change, wrong", [({"rank": 4}, True), ({"rank": 0}, True), ({"score": float("nan")}, True), ({"item_id": "other"}, True), ({}, False)])
def test_contract_of_candidates(spark, change, wrong):
    """Ranks without gaps from 1, finite scores and known items; a list of each source by itself."""
    held = [{"query_id": "z", "item_id": f"p{n}", "source": s, "score": 9.0 - n, "rank": n} for s in "st" for n in (1, 2, 3)]
    held[2] |= change
    items = spark.createDataFrame([(f"p{n}",) for n in (1, 2, 3, 4)], "item_id string")
    c = spark.createDataFrame([tuple(h[k] for k in ("query_id", "item_id", "source", "score", "rank")) for h in held], SCHEMA)
    if wrong:
        with pytest.raises(contracts.CandidateError):
            contracts.validate_candidates(c, items)
    else:
        contracts.validate_candidates(c, items)


def test_recall_by_hand(spark):
    """Four queries of the truth: half found, found too late, found twice by two sources, and none; one asked without truth."""
    t = truth(spark, [("u", "a"), ("u", "b"), ("v", "c"), ("w", "d"), ("x", "e")])
    c = frame(spark, [("u", "a", "s", 5.0, 1), ("u", "q", "s", 4.0, 2), ("v", "q", "s", 5.0, 1), ("v", "c", "s", 4.0, 2), ("w", "d", "s", 1.0, 1), ("w", "d", "t", 1.0, 1), ("y", "a", "s", 1.0, 1)])
    assert rows(evaluate.recall_at(c, t, [1, 2]), "k", "recall", "queries") == [(1, 0.375, 4), (2, 0.625, 4)]
    asked = spark.createDataFrame([("u",), ("y",)], "query_id string")
    assert rows(evaluate.recall_over_queries(c, t, asked, [2]), "recall", "queries") == [(0.25, 2)]
    with pytest.raises(contracts.SchemaError):
        evaluate.ranking_metrics(c, t, asked, [2])
    with pytest.raises(contracts.SchemaError):
        evaluate.ranking_metrics(c, t.limit(0), asked, [2])
    assert evaluate.recovered(c.where("source = 't'"), c.where("source = 's'"), t, 2).first().recovered == 2


def test_tables_of_folds_and_negatives(spark):
    oof = spark.createDataFrame([(f, "q", f"i{f}", f % 2) for f in range(3)], "fold int, query_id string, item_id string, label int")
    assert contracts.verify_oof(oof) == {"rows": 3, "folds": 3, "positives": 1, "status": True}
    for bad in (oof.unionByName(oof.limit(1)), oof.where("fold <> 1"), oof.withColumn("label", oof.label + 1)):
        with pytest.raises(contracts.SchemaError):
            contracts.verify_oof(bad)
    t = truth(spark, [("q", "a"), ("q", "b")])
    assert contracts.ground_truth_relation(t).count() == 2
    with pytest.raises(contracts.SchemaError):
        contracts.ground_truth_relation(t.unionByName(t))
    assert contracts.hard_training_rows(t, truth(spark, [("q", "c")])).first().label == 0
    for bad in ([("q", "a")], [("q", "c"), ("q", "c")]):
        with pytest.raises(contracts.SchemaError):
            contracts.hard_training_rows(t, truth(spark, bad))


def test_rrf(spark):
    c = frame(spark, [("q", "a", "bm25", 3.0, 1), ("q", "b", "bm25", 2.0, 2), ("q", "c", "dense", 1.0, 1)])
    assert fusion.reciprocal_rank_fusion(c).where("rank = 1").first().item_id == "a"


def test_weighted_rrf_compresses_after_dedup(spark):
    c = frame(spark, [("q", "a", "s0", 0.0, 1), ("q", "a", "s0", 0.0, 2), ("q", "b", "s0", 0.0, 3), ("q", "b", "s1", 0.0, 1), ("q", "c", "s1", 0.0, 2)])
    out = fusion.weighted_rrf(c, {"s0": 1, "s1": 1}).orderBy("rank").collect()
    assert [r.item_id for r in out] == ["b", "a", "c"]
    assert [r.score for r in out] == [round(x, 9) for x in (1 / 62 + 1 / 61, 1 / 61, 1 / 62)]
    assert [r.item_id for r in fusion.weighted_rrf(c, {"s0": 3, "s1": 1}, limit=2).orderBy("rank").collect()] == ["b", "a"]


def test_weight_zero_brings_items_in(spark):
    c = frame(spark, [("q", "a", "s0", 0.0, 1), ("q", "z", "s1", 0.0, 1)])
    assert rows(fusion.weighted_rrf(c, {"s0": 1, "s1": 0}), "item_id", "rank") == [("a", 1), ("z", 2)]


def test_padding(spark):
    ranked = spark.createDataFrame([("q", "m", 1.0)], "query_id string, item_id string, score double")
    queries = spark.createDataFrame([("q",), ("r",)], "query_id string")
    corpus = spark.createDataFrame([(x,) for x in "zmabc"], "item_id string")
    out = cand.pad_to_k(ranked, queries, corpus, 3)
    assert [r.item_id for r in out.where("query_id = 'q'").orderBy("rank").collect()] == ["m", "a", "b"]
    assert [r.item_id for r in out.where("query_id = 'r'").orderBy("rank").collect()] == ["a", "b", "c"]


def test_hard_negatives(spark):
    c = frame(spark, [("q", "a", "x", 2.0, 1), ("q", "b", "x", 1.0, 2), ("q", "b", "y", 9.0, 1)])
    out = cand.hard_negatives(c, truth(spark, [("q", "a")]), 5)
    assert rows(out, "item_id", "source", "sampling_order") == [("b", "x", 1)]


def test_pair_features_fill(spark):
    c = frame(spark, [("q", "a", "x", 2.0, 1), ("q", "b", "y", 5.0, 1)])
    f = fusion.filled_features(fusion.pair_features(c, ["x", "y"]), ["x", "y"], 10).where("item_id = 'a'").first()
    assert (f.x_score, f.y_score, f.y_rank, f.y_present, f.retriever_count) == (2.0, 4.0, 11, 0, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("abcdef"), st.sampled_from("xy"), st.integers(0, 3)), min_size=1, max_size=30), st.integers(1, 5))
def test_top_k_is_unique_and_ordered(spark, data, k):
    out = cand.rank_candidates(frame(spark, [(q, i, s, float(v), 1) for q, i, s, v in data]), limit=k).collect()
    for q in {d[0] for d in data}:
        best = {}
        for a, i, _, v in data:
            if a == q:
                best[i] = max(best.get(i, 0.0), float(v))
        want = sorted(best, key=lambda i: (-best[i], i))[:k]
        assert [r.item_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)] == want
