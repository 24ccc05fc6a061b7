"""Re-ranking a pool by a scorer of text pairs: texts, cuts by priority, cached chunks, and what depth and a mix bring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluate, ml
from lodestone.operators.candidates import top_k

#: Labels of the parts of a query and an item. Fixed values.
QUERY, FILTERS, TITLE, PARAMS, DESCRIPTION = "Запрос: ", "Фильтры: ", "Название: ", "Параметры: ", "Описание: "
#: The score of a pair that no scorer saw, and tokens kept free between a pair's parts. Fixed values.
UNSCORED, SPARE = -999.0, 4

BLANK = r"(?U)\s+"


def _part(c: Column | str, label: str, nan: bool = True) -> Column:
    """The label and the trimmed text, or null for none; a text 'nan' is none."""
    text = F.regexp_replace(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when((text != "") & ((F.lower(text) != "nan") if nan else F.lit(True)), F.concat(F.lit(label), text))


def query_text(query: Column | str, filters: Column | str) -> Column:
    """Query and filters, a labelled line each; what is missing has no line."""
    return F.concat_ws("\n", _part(query, QUERY, nan=False), _part(filters, FILTERS))


def item_prefix(title: Column | str, params: Column | str) -> Column:
    return F.concat_ws("\n", _part(title, TITLE), _part(params, PARAMS))


def item_description(description: Column | str) -> Column:
    return F.coalesce(_part(description, DESCRIPTION), F.lit(""))


def words(c: Column) -> Column:
    """Words between blanks, which stand for a model's tokens."""
    return F.filter(F.split(c, BLANK), lambda w: w != "")


def item_text(query: Column, prefix: Column, description: Column, max_length: int = 512) -> Column:
    """Prefix and description as one text; where query and text have over max_length tokens, the description gives way, never the prefix."""
    whole = F.concat_ws("\n", F.nullif(prefix, F.lit("")), F.nullif(description, F.lit("")))
    fits = F.size(words(query)) + F.size(words(whole)) <= max_length
    room = F.greatest(F.lit(0), F.lit(max_length - SPARE) - F.size(words(query)) - F.size(words(prefix)))
    cut = F.array_join(F.slice(words(description), F.lit(1), room), " ")
    return F.when(fits | (prefix == "") | (description == ""), whole).otherwise(F.concat_ws("\n", prefix, F.nullif(cut, F.lit(""))))


def pair_texts(pool: DataFrame, queries: DataFrame, items: DataFrame, max_length: int = 512) -> DataFrame:
    """query_id, item_id, query_text, item_text of a pool's pairs. queries: query_id, search_query, params; items: item_id, title, params, description."""
    asked = queries.select("query_id", query_text("search_query", "params").alias("query_text"))
    held = items.select("item_id", item_prefix("title", "params").alias("__p"), item_description("description").alias("__d"))
    pairs = pool.select("query_id", "item_id").distinct().join(asked, "query_id").join(held, "item_id")
    return pairs.select("query_id", "item_id", "query_text", item_text(F.col("query_text"), F.col("__p"), F.col("__d"), max_length).alias("item_text"))


def score_pool(pairs: DataFrame, scorer: Callable[[list[str], list[str]], Sequence[float]], folder: str, chunks: int = 16) -> DataFrame:
    """Scores of all pairs, in chunks by a hash of the query, each kept in a folder of its own as soon as it is whole: a second run scores only what is missing.

    A chunk's folder counts once its writer has marked it as done.
    """
    spark = pairs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    marked = pairs.withColumn("__chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    for n in range(chunks):
        done = hadoop.Path(f"{folder}/chunk={n}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            ml.rerank(marked.where(F.col("__chunk") == n).drop("__chunk"), scorer, limit=1 << 30).select("query_id", "item_id", "rerank_score").write.mode("overwrite").parquet(f"{folder}/chunk={n}")
    return spark.read.parquet(*(f"{folder}/chunk={n}" for n in range(chunks)))


def with_rerank_score(features: DataFrame, scores: DataFrame) -> DataFrame:
    """The selector's features and the scorer's; a pair that it didn't see has UNSCORED."""
    once = scores.groupBy("query_id", "item_id").agg(F.max("rerank_score").alias("rerank_score"))
    return features.join(once, ["query_id", "item_id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(UNSCORED)))


def depth_ablation(pool: DataFrame, scores: DataFrame, truth: DataFrame, depths: Sequence[int], k: int = 50) -> DataFrame:
    """depth, recall, queries: only the pool's first `depth` ranks are re-ranked and answer. All depths in one pass."""
    deep = pool.join(scores, ["query_id", "item_id"]).withColumn("depth", F.explode(F.filter(F.array(*map(F.lit, depths)), lambda d: d >= F.col("rank")))).drop("rank")
    best = top_k(deep, k, "rerank_score", by=("depth", "query_id"))
    relevant = truth.groupBy("query_id").agg(F.count_distinct("item_id").alias("relevant"))
    hits = best.join(truth.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi").groupBy("depth", "query_id").agg(F.count_distinct("item_id").alias("hits"))
    every = relevant.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    joined = every.join(hits, ["depth", "query_id"], "left").withColumn("recall", F.coalesce("hits", F.lit(0)) / F.col("relevant"))
    return joined.groupBy("depth").agg(F.round(F.avg("recall"), 9).alias("recall"), F.count("*").alias("queries"))


def rerank_report(pool: DataFrame, scores: DataFrame, truth: DataFrame, k: int = 50, depth: int = 500) -> dict[str, DataFrame]:
    """What a pool holds at all, what re-ranking makes of it, hits that only one of both orders has, and where the truth stood in the pool."""
    again = top_k(pool.drop("rank", "score").join(scores, ["query_id", "item_id"]), depth, "rerank_score")
    return {
        "pool_coverage": evaluate.recall_at(pool, truth, [k, depth]),
        "reranked": evaluate.recall_at(again, truth, [k]),
        "quadrants": evaluate.hit_quadrants(pool, again, truth, k),
        "rank_buckets": evaluate.rank_buckets(pool, truth, (50, 100, 200, 300, 500)),
    }
