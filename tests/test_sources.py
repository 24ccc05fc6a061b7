import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import contracts, ml, splits
from lodestone.sources import experiments, tables
from lodestone.streaming import recall as stream


def test_submission_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("q" * 16, 0), ("r" * 16, 1)], "query_id string, position long")
    items = spark.createDataFrame([("i" * 16,)], "item_id string")
    ranked = spark.createDataFrame([("q" * 16, "i" * 16, 1)], "query_id string, item_id string, rank int")
    tables.write_submission(ranked, q, items, f"file://{tmp_path}/answer")
    got = {r.query_id: r.answer for r in tables.load_answers(spark, f"file://{tmp_path}/answer").collect()}
    assert got == {"q" * 16: "i" * 16, "r" * 16: ""}


def test_submission_is_one_file_in_order(spark, tmp_path):
    q = spark.createDataFrame([("r" * 16, 1), ("q" * 16, 0)], "query_id string, position long")
    items = spark.createDataFrame([("i" * 16,), ("j" * 16,)], "item_id string")
    ranked = spark.createDataFrame([("q" * 16, "j" * 16, 2), ("q" * 16, "i" * 16, 1)], "query_id string, item_id string, rank int")
    path = tmp_path / "answer.csv"
    path.write_text("old")
    tables.write_submission(ranked, q, items, f"file://{path}", version="v2")
    assert path.read_text() == f"query_id,answer\n{'q' * 16},{'i' * 16} {'j' * 16}\n{'r' * 16},\n" == (tmp_path / "answer.csv.v2").read_text()
    assert tables.read_json(f"file://{path}.v2.json", spark)["answers"] == 2
    assert not [p for p in tmp_path.iterdir() if "writing" in p.name or "ready" in p.name or "before" in p.name]
    for bad in ("\ufeffquery_id,answer\n", "query_id,answers\n", f"query_id,answer\n{'r' * 16},\n{'q' * 16},\n", f"query_id,answer\n{'q' * 16},\n{'q' * 16},\n{'r' * 16},\n", f"query_id,answer\n{'q' * 16}\n{'r' * 16},\n"):
        wrong = tmp_path / f"wrong{hash(bad)}.csv"
        wrong.write_text(bad, encoding="utf-8")
        with pytest.raises(contracts.SchemaError):
            tables.validate_submission(spark, f"file://{wrong}", q, items)


def test_models_are_kept(spark, tmp_path):
    model = ml.TwoTower(vocabulary=64, width=4, dimension=3)
    ml.train_two_tower(model, [("red phone", "phone red"), ("old lamp", "lamp")], 2)
    model.save(spark, str(tmp_path / "towers"))
    again = ml.TwoTower.load(spark, str(tmp_path / "towers"))
    assert np.array_equal(model.encode(["red lamp"], "query"), again.encode(["red lamp"], "query"))
    table = spark.createDataFrame([("q", str(i), i % 2, float(i % 2)) for i in range(40)], "query_id string, item_id string, label int, x double")
    ml.save_selector(ml.train_selector(table, ["x"], 2, 2), str(tmp_path / "selector"))
    best = ml.rank_with_selector(ml.load_selector(str(tmp_path / "selector")), table, 20)
    assert {r.label for r in best.collect()} == {1}


def test_experiments(spark, tmp_path):
    runs = experiments.Experiments()
    with pytest.raises(ValueError):
        runs.best()
    for name, recall in (("b", 0.5), ("a", 0.5), ("c", 0.1)):
        runs.add(experiments.Run(name, "d", "c", {"recall@50": recall}))
    runs.add(experiments.Run("none", "d", "c"))
    assert runs.best().run_id == "a"
    with pytest.raises(ValueError):
        runs.add(experiments.Run("x", "other", "c"))
    runs.write(spark, str(tmp_path / "runs.json"))
    assert experiments.Experiments.load(spark, str(tmp_path / "runs.json")).runs == runs.runs


def test_candidate_sink(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",)], "item_id string")
    c = spark.createDataFrame([("q", "b", "x", 1.0, 2), ("q", "a", "x", 2.0, 1)], "query_id string, item_id string, source string, score double, rank int")
    assert tables.write_candidates(c, items, str(tmp_path / "c"))["rows"] == 2
    assert [r.item_id for r in spark.read.parquet(str(tmp_path / "c/rows")).collect()] == ["a", "b"]
    with pytest.raises(contracts.CandidateError):
        tables.write_candidates(c.where("rank = 2"), items, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/rows")).count() == 2
    m = tables.metric_rows(spark.createDataFrame([(10, 0.5)], "k int, recall double"), "run").collect()
    assert [tuple(r) for r in m] == [("run", "recall@10", 0.5)]


def test_submission_refuses_unknown_items(spark, tmp_path):
    q = spark.createDataFrame([("q" * 16, 0)], "query_id string, position long")
    ranked = spark.createDataFrame([("q" * 16, "x" * 16, 1)], "query_id string, item_id string, rank int")
    with pytest.raises(contracts.SchemaError):
        tables.write_submission(ranked, q, spark.createDataFrame([("i" * 16,)], "item_id string"), f"file://{tmp_path}/answer")
    assert not (tmp_path / "answer").exists()


def test_contract(spark):
    c = contracts.TableContract(("item_id",), ("item_id",), ("item_id",))
    with pytest.raises(contracts.SchemaError):
        c.validate(spark.createDataFrame([("short",)], "item_id string"))
    with pytest.raises(contracts.SchemaError):
        c.validate(spark.createDataFrame([], "item_id string"))
    with pytest.raises(contracts.SchemaError):
        c.validate(spark.createDataFrame([("a" * 16,), ("a" * 16,)], "item_id string"))
    assert c.validate(spark.createDataFrame([("a" * 16,)], "item_id string"))["rows"] == 1


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[data]\nitems = 'i.parquet'\n")
    a = tables.load_config(str(tmp_path / "c.toml"))
    assert a.values["seed"] == 42 and a.path("x") == tmp_path / "x" and len(a.hash) == 64
    with pytest.raises(tables.ConfigError):
        tables.load_config(str(tmp_path / "none.toml"))


def test_embeddings_and_fingerprint(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.0, 1.0])], "item_id string, embedding array<double>")
    tables.save_embeddings(v, str(tmp_path / "e"), "stub", 2)
    assert tables.load_embeddings(spark, str(tmp_path / "e"), "stub").count() == 2
    with pytest.raises(contracts.SchemaError):
        tables.load_embeddings(spark, str(tmp_path / "e"), "other")
    assert tables.cached_embeddings(spark, str(tmp_path / "none"), "stub", "t") is None and tables.cached_embeddings(spark, str(tmp_path / "e"), "stub", "t") is None
    v.withColumn("embedding", F.transform("embedding", lambda x: x + 1)).write.mode("overwrite").parquet(f"{tmp_path}/e/vectors")
    with pytest.raises(contracts.SchemaError):
        tables.load_embeddings(spark, str(tmp_path / "e"), "stub")
    assert tables.fingerprint(v) == tables.fingerprint(v.repartition(3))


def test_dedup_takes_the_least_row(spark):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("a", 1, "y")], "item_id string, b int, c string")
    assert tuple(splits.dedup_items(d).select("b", "c").first()) == (1, "y")


def test_orphans_are_refused(spark):
    i = spark.createDataFrame([("q", "a")], "query_id string, item_id string")
    with pytest.raises(contracts.SchemaError):
        splits.ground_truth(i, spark.createDataFrame([("b", "train")], "item_id string, split string"))


def test_two_tower_learns():
    pairs = [(f"word{i}", f"word{i} thing") for i in range(30)]
    losses = ml.train_two_tower(ml.TwoTower(vocabulary=512, width=16, dimension=16), pairs, epochs=30, batch=30)
    assert losses[-1] < losses[0]


def test_stream_recall(spark, tmp_path):
    schema = "query_id string, item_id string, rank int"
    for n, data in enumerate(([("q1", "a", 1)], [("q2", "x", 1)])):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch{n}")
    truth = spark.createDataFrame([("q1", "a"), ("q2", "b")], "query_id string, item_id string")
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream.stream_recall(arriving, truth, [1], f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert stream.total_recall(spark.read.parquet(f"{tmp_path}/out"), truth).first().recall == 0.5
