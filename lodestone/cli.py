"""Commands over Parquet tables: python -m lodestone.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from lodestone.operators import candidates as cand
from lodestone.operators import contracts, dense, evaluate, fusion, lexical, ml, preparation, rerank, splits
from lodestone.plans.champion import Depths, champion
from lodestone.session import local_session
from lodestone.sources import experiments, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: str, **defaults) -> None:
        c = commands.add_parser(name, help=text)
        for o in options:
            c.add_argument(f"--{o}", required=True)
        for o, v in defaults.items():
            c.add_argument(f"--{o}", type=type(v), default=v)

    command("prepare", "check the raw tables and write the canonical ones, once for the same inputs", "train", "queries", "items", "output", seed=42)
    command("validate", "check one table's contract", "table", key="item_id")
    command("canonicalize", "write a table in a total order of rows", "table", "output")
    command("split", "item splits, ground truth and query slices of interactions", "interactions", "output", seed=42)
    command("research", "the tables of a research validation", "train", "items", "output", seed=42)
    command("candidates", "candidates of all sources at hand and their fusion", "queries", "items", "output", k=500, towers="", category="")
    command("train", "two towers and a selector over candidates' features", "pairs", "queries", "items", "candidates", "truth", "output", epochs=5)
    command("evaluate", "recall of candidates", "candidates", "truth", k=50)
    command("validation", "BM25 and TF-IDF over validation queries: recall, and a report", "queries", "items", "truth", "output", k=500)
    command("rerank", "re-rank candidates by shared words, and what that changes", "queries", "items", "candidates", "truth", "output", k=50)
    command("rank", "rank candidates by a trained selector", "candidates", "model", "output", k=50)
    command("predict", "a submission from ranked rows", "ranked", "queries", "items", "output", k=50, version="")
    command("verify", "check a submission", "answers", "queries", "items", k=50)
    command("answer", "the champion pipeline", "train", "queries", "items", "output", routes=10)
    command("smoke", "all steps on a few made-up rows", "output")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local_session()
    load = lambda path: tables.load_table(spark, path)
    if a.command == "prepare":
        prepare(spark, load(a.train), load(a.queries), load(a.items), a.output, a.seed)
    elif a.command == "validate":
        print(json.dumps(contracts.TableContract((a.key,), (a.key,), (a.key,)).validate(load(a.table))))
    elif a.command == "canonicalize":
        tables.write_sorted(load(a.table), a.output)
    elif a.command == "split":
        rows = load(a.interactions)
        parts = splits.item_splits(rows.select("item_id").distinct(), a.seed)
        truth = splits.ground_truth(rows, parts)
        for name, df in (("item_splits", parts), ("ground_truth", truth), ("query_slices", splits.query_slices(truth))):
            df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    elif a.command == "research":
        for name, df in preparation.research_split(load(a.train), load(a.items), seed=a.seed).items():
            df.write.mode("overwrite").parquet(f"{a.output}/{name}")
    elif a.command == "candidates":
        items = load(a.items)
        found = sources(spark, load(a.queries), items, a.k, a.towers, a.category)
        tables.write_candidates(found, items, f"{a.output}/candidates")
        held = load(f"{a.output}/candidates/rows")
        fusion.reciprocal_rank_fusion(held, limit=a.k).write.mode("overwrite").parquet(f"{a.output}/fused")
    elif a.command == "train":
        train(spark, load(a.pairs), load(a.queries), load(a.items), load(a.candidates), load(a.truth), a.output, a.epochs)
    elif a.command == "validation":
        validation(spark, load(a.queries), load(a.items), load(a.truth), a.output, a.k)
    elif a.command == "rerank":
        pool = fusion.reciprocal_rank_fusion(load(a.candidates), limit=500)
        items, queries = load(a.items), load(a.queries)
        pairs = pool.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").join(items.select("item_id", F.col("text").alias("item_text")), "item_id")
        scores = rerank.score_pool(pairs, shared_words, f"{a.output}/scores", chunks=4)
        experiments.write_report(rerank.rerank_report(pool, scores, load(a.truth), a.k), f"{a.output}/report.json")
    elif a.command == "rank":
        held = load(a.candidates)
        meta = tables.read_json(f"{a.model}/features.json", spark)
        table = fusion.filled_features(fusion.pair_features(held, meta["sources"]), meta["sources"], meta["depth"])
        tables.write_predictions(ml.rank_with_selector(ml.load_selector(f"{a.model}/selector"), table, a.k), a.output)
    elif a.command == "evaluate":
        print(json.dumps({str(r.k): r.recall for r in evaluate.recall_at(load(a.candidates), load(a.truth), [k for k in (10, 20, 50, 100, 200, 500) if k <= a.k]).collect()}))
    elif a.command == "predict":
        tables.write_submission(load(a.ranked), load(a.queries), load(a.items), a.output, a.k, version=a.version or None)
    elif a.command == "verify":
        print(json.dumps(tables.validate_submission(spark, a.answers, load(a.queries), load(a.items), None, a.k)))
    elif a.command == "answer":
        queries, items = load(a.queries), load(a.items)
        tables.write_submission(champion(load(a.train), queries, items, Depths(routes=a.routes)), queries, items, a.output, 50, 50)
    elif a.command == "smoke":
        print(json.dumps(smoke(spark, a.output)))
    return 0


def prepare(spark, train_rows, queries, items, output: str, seed: int) -> dict:
    """Five canonical tables and a report of them; nothing is done again for the same inputs and seed."""
    inputs = ":".join(tables.fingerprint(df) for df in (train_rows, queries, items))
    if tables.cached(inputs, output, seed, spark):
        return tables.read_json(f"{output}/data_report.json", spark)
    counts = preparation.validate_raw(train_rows, queries, items)
    made = preparation.canonical_tables(train_rows, queries, items)
    counts |= preparation.build_report(train_rows, made).first().asDict()
    for name, df in made.items():
        tables.write_sorted(df, f"{output}/{name}")
    report = {"counts": counts, "fingerprints": {n: tables.fingerprint(spark.read.parquet(f"{output}/{n}")) for n in made}}
    tables.write_json(report, f"{output}/data_report.json", spark)
    tables.write_json({"inputs": inputs, "seed": seed}, f"{output}/manifest.json", spark)
    return report


def sources(spark, queries, items, k: int, towers: str = "", category: str = ""):
    """The candidate relation of BM25 (by a category column, if named, with the whole as fallback), TF-IDF, and trained towers if there are any."""
    found = lexical.bm25_by_category(items, queries, k, "fallback", category=category) if category else lexical.bm25(items, queries, k)
    out = [found.withColumn("source", F.lit("bm25")), lexical.tfidf(items, queries, k, pad=False).withColumn("source", F.lit("tfidf"))]
    if towers:
        model = ml.TwoTower.load(spark, towers)
        vectors = [dense.encode(df, key, "text", model.encoder(side), model.dimension) for df, key, side in ((items, "item_id", "item"), (queries, "query_id", "query"))]
        out.append(dense.exact_top_k(*vectors, k).withColumn("source", F.lit("two_tower")))
    columns = ("query_id", "item_id", "source", "score", "rank")
    return cand.union(*(df.select(*columns) for df in out))


def train(spark, pairs, queries, items, candidates, truth, output: str, epochs: int, depth: int = 500, limit: int = 50_000) -> None:
    """Towers on at most `limit` (query, item) texts, first in the order of a hash, and a selector over the candidates' features."""
    texts = preparation.training_pairs(pairs.select("query_id", "item_id").distinct(), queries, items).select("query_text", "item_text").distinct()
    some = texts.orderBy(F.xxhash64("query_text", "item_text"), "query_text", "item_text").limit(limit).collect()
    model = ml.TwoTower()
    ml.train_two_tower(model, [tuple(r) for r in some], epochs)
    model.save(spark, f"{output}/towers")
    named = [r.source for r in candidates.select("source").distinct().orderBy("source").collect()]
    table = fusion.labelled(fusion.filled_features(fusion.pair_features(candidates, named), named, depth), truth)
    ml.save_selector(ml.train_selector(table), f"{output}/selector")
    tables.write_json({"sources": named, "depth": depth, "features": tables.feature_dictionary(table)}, f"{output}/features.json", spark)


def validation(spark, queries, items, truth, output: str, k: int) -> dict:
    """Recall of BM25 and TF-IDF at the usual depths: metrics as rows, and a report."""
    ks = [n for n in (10, 20, 50, 100, 200, 500) if n <= k]
    parts = {name: evaluate.ranking_metrics(ranked, truth, queries.join(truth, "query_id", "left_semi"), ks) for name, ranked in (("bm25", lexical.bm25(items, queries, k)), ("tfidf", lexical.tfidf(items, queries, k)))}
    cand.union(*(tables.metric_rows(df, name) for name, df in parts.items())).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{output}/metrics")
    return experiments.write_report(parts, f"{output}/report.json")


def shared_words(queries: list[str], items: list[str]) -> list[float]:
    """Shared words over the query's: stands for a cross-encoder, of which none is here."""
    return [len(set(q.split()) & set(i.split())) / max(1, len(set(q.split()))) for q, i in zip(queries, items, strict=True)]


def smoke(spark, output: str) -> dict:
    """All steps on a few made-up rows: candidates, training, ranking, a submission and its check."""
    words = ("red", "blue", "old", "new", "phone", "chair", "lamp", "bike")
    items = spark.createDataFrame([(f"{n:016d}", f"{words[n % 4]} {words[4 + n // 4 % 4]} {n}") for n in range(32)], "item_id string, text string")
    queries = spark.createDataFrame([(f"q{n:015d}", f"{words[n % 4]} {words[4 + n % 4]}", n) for n in range(8)], "query_id string, text string, position long")
    pairs = spark.createDataFrame([(f"q{n:015d}", f"{m:016d}") for n in range(8) for m in range(32) if m % 4 == n % 4 and m // 4 % 4 == n % 4], "query_id string, item_id string")
    at = lambda name: f"{output}/{name}"
    for name, df in (("items", items), ("queries", queries), ("pairs", pairs)):
        df.write.mode("overwrite").parquet(at(name))
    tables.write_candidates(sources(spark, queries, items, 20), items, at("candidates"))
    held = spark.read.parquet(at("candidates/rows"))
    train(spark, pairs, queries, items, held, pairs, at("model"), 2)
    meta = tables.read_json(at("model/features.json"), spark)
    table = fusion.filled_features(fusion.pair_features(held, meta["sources"]), meta["sources"], meta["depth"])
    tables.write_predictions(ml.rank_with_selector(ml.load_selector(at("model/selector")), table, 10), at("predictions"))
    ranked = spark.read.parquet(at("predictions"))
    found = tables.write_submission(ranked, queries, items, at("answer.csv"), 10)
    recall = evaluate.recall_at(ranked, pairs, [10]).first().recall
    return {"answers": found["answers"], "recall@10": recall}


if __name__ == "__main__":
    raise SystemExit(main())
