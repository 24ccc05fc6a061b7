"""From the raw tables to what the operators work on: checks, canonical tables, training pairs, the research split, samples to look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.ids import context_id, hash_number
from lodestone.operators import splits
from lodestone.operators.candidates import row_rank
from lodestone.operators.contracts import SchemaError, domain_report, duplicate_keys, require_columns

#: Columns that make a search context, and those that the raw tables need.
CONTEXT = ("search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category")


def safe_bool(c: Column) -> Column:
    """Null and NaN are false; of numbers, 0 alone is."""
    return F.coalesce(~F.isnan(c.cast("double")) & (c.cast("double") != 0), F.lit(False))


def safe_int(c: Column, default: int = 0) -> Column:
    """A whole number, or the default where there is none."""
    text = c.cast("string")
    return F.coalesce(text.try_cast("int"), text.try_cast("double").try_cast("int"), F.lit(default))


def raw_report(train: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """One row over the three raw tables: rows, ids that aren't 16 characters, repeated ids, delivery flags but 0 and 1."""
    for df, needed in ((train, (*CONTEXT, "item_id")), (queries, ("query_id", *CONTEXT)), (items, ("item_id",))):
        require_columns(df, needed)
    bad = lambda c: F.count_if(F.col(c).isNull() | (F.length(c) != 16))
    one = train.agg(F.count("*").alias("train_rows"), bad("item_id").alias("train_bad_ids"))
    two = queries.agg(F.count("*").alias("query_rows"), bad("query_id").alias("query_bad_ids")).crossJoin(duplicate_keys(queries, ["query_id"]).withColumnRenamed("duplicate_keys", "repeated_queries"))
    three = items.agg(F.count("*").alias("item_rows"), bad("item_id").alias("item_bad_ids")).crossJoin(duplicate_keys(items, ["item_id"]).withColumnRenamed("duplicate_keys", "repeated_items"))
    flags = domain_report(train, (), ("search_is_delivery_search",))
    return one.crossJoin(two).crossJoin(three).crossJoin(flags)


def validate_raw(train: DataFrame, queries: DataFrame, items: DataFrame) -> dict:
    found = raw_report(train, queries, items).first().asDict()
    if broken := {k: v for k, v in found.items() if (v == 0) == k.endswith("_rows")}:
        raise SchemaError(str(broken))
    return found


def canonical_tables(train: DataFrame, queries: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """The five tables of a canonical build. A context or an item that occurs in several forms has one, the least."""
    named = train.withColumn("query_id", context_id(CONTEXT))
    item_columns = [c for c in train.columns if c.startswith("item_")]
    return {
        "queries_train": named.select("query_id", *CONTEXT).dropDuplicates(["query_id"]),
        "items_train": splits.dedup_items(train.select(*item_columns)),
        "interactions": splits.distinct_interactions(named),
        "benchmark_queries": queries,
        "benchmark_items": items,
    }


def build_report(train: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: interactions before and after they are distinct, and item snapshots that went."""
    raw = train.agg(F.count("*").alias("raw_interactions"))
    kept = tables["interactions"].agg(F.count("*").alias("unique_interactions"))
    snapshots = train.select(*(c for c in train.columns if c.startswith("item_"))).distinct().agg(F.count("*").alias("snapshots"))
    items = tables["items_train"].agg(F.count("*").alias("items"))
    rows = raw.crossJoin(kept).crossJoin(snapshots).crossJoin(items)
    return rows.select("raw_interactions", "unique_interactions", (F.col("raw_interactions") - F.col("unique_interactions")).alias("interaction_duplicates_dropped"), (F.col("snapshots") - F.col("items")).alias("item_snapshots_dropped"))


def training_pairs(pairs: DataFrame, queries: DataFrame, items: DataFrame, strict: bool = True) -> DataFrame:
    """query_id, item_id and both texts. strict: a pair that names an unknown query or item is an error; else it keeps a null text."""
    out = pairs
    for key, text, table in (("query_id", "query_text", queries), ("item_id", "item_text", items)):
        if text not in out.columns:
            out = out.join(table.select(key, F.col("text").alias(text)), key, "left")
    if strict and not out.where("query_text is null or item_text is null").isEmpty():
        raise SchemaError("pairs of unknown queries or items")
    return out


def clean_pairs(train: DataFrame, limit: int = 15_000, seed: int = 42, query: str = "search_query", title: str = "title") -> DataFrame:
    """Training pairs for an encoder: without null titles and blank queries, each (query, item) once, at most `limit` in the order of a hash."""
    fine = train.where(F.col(query).isNotNull() & F.col(title).isNotNull() & (F.trim(F.regexp_replace(query, tx.SPACE, " ")) != ""))
    others = [c for c in train.columns if c not in (query, "item_id")]
    once = fine.withColumn("__r", row_rank([query, "item_id"], [F.asc_nulls_last(c) for c in others] or [F.asc(query)])).where("__r = 1").drop("__r")
    return once.orderBy(hash_number(F.concat(F.lit(f"{seed}:"), query, F.lit("|"), "item_id")), query, "item_id").limit(limit)


def research_split(train: DataFrame, corpus: DataFrame, train_fold: int = 0, folds: int = 5, seed: int = 42, category: str = "microcat") -> dict[str, DataFrame]:
    """The tables of a research validation: contexts of the validation folds that have positives, with how many they have, positives with the category of
    both tables, and the ground truth. An item of the corpus without a category is an error.

    train: query_id, item_id, a category and the context's columns; corpus: item_id and a category.
    """
    if not corpus.where(F.col(category).isNull()).isEmpty():
        raise SchemaError("items of the corpus without a category")
    positives = train.select("query_id", "item_id", F.col(category).alias("train_category")).distinct().join(corpus.select("item_id", F.col(category).alias("corpus_category")), "item_id")
    known = positives.groupBy("query_id").agg(F.count_distinct("item_id").alias("known_positive_count"))
    contexts = splits.context_folds(train, folds, seed)
    validation = contexts.where(F.col("fold") != train_fold).join(known, "query_id")
    truth = positives.join(validation.select("query_id"), "query_id", "left_semi").select("query_id", "item_id").distinct()
    return {"positives": positives, "validation_contexts": validation, "ground_truth": truth}


def router_texts(query: str = "search_query", params: str = "search_infm_params_text", category: str = "search_category") -> tuple[Column, Column]:
    """What a router reads: word_text, the query, its filters and cat_<category> with a blank between each, as they are; char_text, the query between blanks."""
    q, p, c = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (query, params, category))
    return F.trim(F.concat(q, F.lit(" "), p, F.lit(" cat_"), c)).alias("word_text"), F.concat(F.lit(" "), F.translate(q, "\t", " "), F.lit(" ")).alias("char_text")


def query_flags(queries: DataFrame, train_queries: DataFrame, query: str = "search_query", params: str = "params", category: str = "category", special: Sequence[int] = (0, 114)) -> DataFrame:
    """query_id, slice: a row for each slice a query is in. By the train's texts, filters, words, and categories of their own."""
    seen = train_queries.select(F.col(query).alias("__q")).distinct().withColumn("__seen", F.lit(True))
    words = F.size(F.filter(F.split(F.coalesce(F.col(query), F.lit("")), tx.SPACE), lambda w: w != ""))
    flagged = queries.join(seen, F.col(query) == F.col("__q"), "left")
    is_seen, filters = F.coalesce("__seen", F.lit(False)), F.length(F.trim(F.coalesce(F.col(params), F.lit("")))) > 0
    slices = {"seen_query": is_seen, "unseen_query": ~is_seen, "filters_present": filters, "filters_absent": ~filters, "short_query": words <= 2, "long_query": words >= 4} | {f"category_{c}": F.coalesce(F.col(category) == c, F.lit(False)) for c in special}
    return flagged.select("query_id", F.explode(F.filter(F.array(*(F.when(on, F.lit(name)) for name, on in slices.items())), lambda x: x.isNotNull())).alias("slice"))


def audit_picks(queries: DataFrame, each: int = 10, total: int = 50, query: str = "search_query", category: str = "category", location: str = "location", order: str = "position") -> DataFrame:
    """query_id, position: queries to read, the first of each kind (category 0, a digit, the only one of its location, long, short), filled up with the first others."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(query), F.lit("")), tx.SPACE), lambda w: w != ""))
    alone = F.count("*").over(Window.partitionBy(location)) == 1
    kinds = {"any_category": F.col(category) == 0, "digits": F.coalesce(F.col(query), F.lit("")).rlike(r"\p{Nd}"), "alone": alone & F.col(location).isNotNull(), "long": words >= 4, "short": words <= 2}
    marked = queries.withColumns({f"__{k}": F.coalesce(c, F.lit(False)) for k, c in kinds.items()})
    picked = marked.select("query_id", order, F.explode(F.array(*(F.when(F.col(f"__{k}"), F.lit(k)) for k in kinds))).alias("kind")).where("kind is not null")
    firsts = picked.withColumn("__r", row_rank(["kind"], [F.asc(order), F.asc("query_id")])).where(F.col("__r") <= each).select("query_id", order).distinct().withColumn("__b", F.lit(0))
    others = queries.select("query_id", order).orderBy(order, "query_id").limit(each * len(kinds) + total).withColumn("__b", F.lit(1))
    best = firsts.unionByName(others).groupBy("query_id", order).agg(F.min("__b").alias("__b"))
    return best.orderBy("__b", order, "query_id").limit(total).select("query_id", order)


def query_history(queries: DataFrame, train: DataFrame, corpus: DataFrame, query: str = "search_query") -> DataFrame:
    """query_id and what the train has under the same text, 0 if nothing: rows, distinct items, and both of the corpus's items."""
    known = corpus.select("item_id").distinct().withColumn("__in", F.lit(True))
    stats = train.join(known, "item_id", "left").groupBy(query).agg(
        F.count("*").alias("train_rows"), F.count_distinct("item_id").alias("train_unique_items"), F.count("__in").alias("benchmark_rows"), F.count_distinct(F.when(F.col("__in"), F.col("item_id"))).alias("benchmark_unique_items"))
    joined = queries.select("query_id", query).join(stats, query, "left")
    return joined.select("query_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("train_rows", "train_unique_items", "benchmark_rows", "benchmark_unique_items")), F.col("train_rows").isNotNull().alias("exact_query_in_train"))


def positive_signals(pairs: DataFrame) -> DataFrame:
    """One row, shares of positive pairs: the query's phrase stands in the item's text, and category and location are the same.

    pairs: search_query, item_text, q_category, i_category, q_location, i_location. An empty query stands in every text.
    """
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 9)
    return pairs.agg(mean(F.contains(tx.normalize("item_text"), tx.normalize("search_query"))).alias("phrase_in_text"), mean(F.col("q_category") == F.col("i_category")).alias("same_category"), mean(F.col("q_location") == F.col("i_location")).alias("same_location"))
