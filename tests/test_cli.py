import json

from lodestone import cli


def test_commands(spark, tmp_path, capsys):
    q, i = "q" * 16, "i" * 16
    spark.createDataFrame([(q, i)], "query_id string, item_id string").write.parquet(f"{tmp_path}/pairs")
    spark.createDataFrame([(q, "red phone", 0)], "query_id string, text string, position long").write.parquet(f"{tmp_path}/queries")
    spark.createDataFrame([(i, "red phone")], "item_id string, text string").write.parquet(f"{tmp_path}/items")
    at = lambda n: f"{tmp_path}/{n}"
    assert cli.main(["validate", "--table", at("items")]) == 0
    cli.main(["split", "--interactions", at("pairs"), "--output", at("split")])
    assert spark.read.parquet(at("split/ground_truth")).count() == 1
    cli.main(["candidates", "--queries", at("queries"), "--items", at("items"), "--output", at("found")])
    capsys.readouterr()
    cli.main(["evaluate", "--candidates", at("found/candidates/rows"), "--truth", at("pairs")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"10": 1.0, "20": 1.0, "50": 1.0}
    cli.main(["predict", "--ranked", at("found/fused"), "--queries", at("queries"), "--items", at("items"), "--output", "file://" + at("answer")])
    cli.main(["verify", "--answers", "file://" + at("answer"), "--queries", at("queries"), "--items", at("items")])


def test_smoke(spark, tmp_path, capsys):
    cli.main(["smoke", "--output", f"file://{tmp_path}/s"])
    found = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert found["answers"] == 8 and found["recall@10"] > 0.9
    at = lambda n: f"file://{tmp_path}/s/{n}"
    cli.main(["validation", "--queries", at("queries"), "--items", at("items"), "--truth", at("pairs"), "--output", at("validation")])
    cli.main(["rerank", "--queries", at("queries"), "--items", at("items"), "--candidates", at("candidates/rows"), "--truth", at("pairs"), "--output", at("rerank")])
    cli.main(["rank", "--candidates", at("candidates/rows"), "--model", at("model"), "--output", at("ranked")])
    assert spark.read.parquet(at("ranked")).count() == spark.read.parquet(at("candidates/rows")).select("query_id", "item_id").distinct().count()


def test_prepare(spark, tmp_path):
    a, b = "a" * 16, "b" * 16
    columns = "search_query string, search_location_id long, search_is_delivery_search int, search_infm_params_text string, search_category long"
    train = spark.createDataFrame([("x", 1, 0, "p", 2, a, "t2"), ("x", 1, 0, "p", 2, a, "t1"), ("y", 1, 0, None, 2, b, "t")], columns + ", item_id string, item_title string")
    queries = spark.createDataFrame([("q" * 16, "x", 1, 0, "p", 2)], "query_id string, " + columns)
    items = spark.createDataFrame([(a,), (b,)], "item_id string")
    out = f"file://{tmp_path}/out"
    report = cli.prepare(spark, train, queries, items, out, 42)
    assert report["counts"]["raw_interactions"] == 3 and report["counts"]["unique_interactions"] == 2 and report["counts"]["item_snapshots_dropped"] == 1
    assert sorted(r.item_title for r in spark.read.parquet(f"{out}/items_train").collect()) == ["t", "t1"]
    made = (tmp_path / "out/data_report.json").stat().st_mtime_ns
    assert cli.prepare(spark, train, queries, items, out, 42) == report and (tmp_path / "out/data_report.json").stat().st_mtime_ns == made
