"""Lexical retrieval: BM25, TF-IDF over word and character n-grams, routed and by field, numbers.

Items and queries become sparse vectors once, by statistics of the whole index; blocks of items meet the queries, and
their tasks keep each query's best (best_in_blocks). A frequent term costs products there, never rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.numeric import score as rounded
from lodestone.operators.blocks import best_in_blocks, best_of_distinct
from lodestone.operators.candidates import pad_to_k, row_rank, top_k, union

Analyzer = Callable[[Column], Column]
K1, B = 1.5, 0.75


def plain_words(c: Column) -> Column:
    return tx.tokens(c)


def lower_words(c: Column) -> Column:
    return tx.tokens(F.lower(c))


def long_words(c: Column) -> Column:
    """Lower-case tokens of two characters or more."""
    return tx.tokens(F.lower(c), 2)


def word_12(c: Column) -> Column:
    return tx.word_ngrams(tx.tokens(tx.normalize(c), 2), 1, 2)


def char_wb_35(c: Column) -> Column:
    return tx.char_wb_ngrams(tx.normalize(c), 3, 5)


def postings(texts: DataFrame, key: str, text: str, analyzer: Analyzer, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, term, tf (and columns kept)."""
    return texts.select(key, *keep, F.explode(analyzer(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy(key, *keep, "term").agg(F.count("*").alias("tf"))


def counted(texts: DataFrame, key: str, text: str, analyzer: Analyzer, by: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """key, by, keep, size (tokens), term (a hash, of the `by` columns too), tf. Texts are dealt by key first, so that counting and weighing need no other exchange."""
    found = texts.select(key, *by, *keep, analyzer(F.coalesce(F.col(text), F.lit(""))).alias("__w")).repartition(F.col(key))
    flat = found.select(key, *by, *keep, F.size("__w").alias("size"), F.explode("__w").alias("term"))
    return flat.select(key, *by, *keep, "size", F.xxhash64(*by, "term").alias("term")).groupBy(key, *by, *keep, "size", "term").agg(F.count("*").alias("tf"))


def frequencies(items: DataFrame, text: str, analyzer: Analyzer, by: tuple[str, ...] = ()) -> DataFrame:
    """by, term, df and n, the items (of each `by`); totals are broadcast, a row for each value of `by`."""
    terms = items.select(*by, F.explode(F.array_distinct(analyzer(F.coalesce(F.col(text), F.lit(""))))).alias("term"))
    df = terms.select(*by, F.xxhash64(*by, "term").alias("term")).groupBy(*by, "term").agg(F.count("*").alias("df"))
    totals = items.groupBy(*by).agg(F.count("*").alias("n"))
    return df.join(F.broadcast(totals), list(by)) if by else df.crossJoin(F.broadcast(totals))


def vectors(weighed: DataFrame, key: str, keep: tuple[str, ...] = (), unit: bool = True) -> DataFrame:
    """key, keep, terms (in ascending order), weights (of length 1 if asked) from key, keep, term, raw."""
    rows = weighed.groupBy(key, *keep).agg(F.sort_array(F.collect_list(F.struct("term", "raw"))).alias("t"))
    weights = F.col("t.raw")
    if unit:
        norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, x: a + x["raw"] * x["raw"]))
        rows = rows.withColumn("norm", norm)
        weights = F.transform("t.raw", lambda x: x / F.col("norm"))
    return rows.select(key, *keep, F.col("t.term").alias("terms"), weights.alias("weights"))


def bm25_vectors(items: DataFrame, queries: DataFrame, text: str = "text", by: tuple[str, ...] = (), k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
    """Items and queries as vectors. Robertson's weights, an idf below 0 counts as 0, a term that a query has twice counts twice. With `by`, an index for each value."""
    lengths = items.select(*by, F.size(plain_words(F.coalesce(F.col(text), F.lit("")))).alias("dl")).groupBy(*by).agg(F.avg("dl").alias("avgdl"))
    terms = counted(items, "item_id", text, plain_words, by).join(frequencies(items, text, plain_words, by).drop(*by), "term")
    terms = terms.join(F.broadcast(lengths), list(by)) if by else terms.crossJoin(F.broadcast(lengths))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avgdl")))
    held = vectors(terms.select("item_id", "term", weight.alias("raw")).where("raw > 0"), "item_id", unit=False)
    asked = vectors(counted(queries, "query_id", text, plain_words, by).select("query_id", "term", F.col("tf").cast("double").alias("raw")), "query_id", unit=False)
    return held, asked


def bm25_scores(items: DataFrame, queries: DataFrame, k: int, text: str = "text", by: tuple[str, ...] = (), k1: float = K1, b: float = B) -> DataFrame:
    """Each query's k best, scores over 0."""
    return best_in_blocks(*bm25_vectors(items, queries, text, by, k1, b), k).drop("block")


def bm25_of_many(items: DataFrame, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Top k, scores over 0, for any number of queries: texts of equal vectors are searched once, and tasks hold a bounded number of queries."""
    return best_of_distinct(*bm25_vectors(items, queries, text), k)


def bm25(items: DataFrame, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Top k, padded with zero scores by id; a query without a token has no rows."""
    ranked = top_k(bm25_scores(items, queries, k, text), k)
    asked = queries.where(F.size(plain_words(F.coalesce(F.col(text), F.lit("")))) > 0)
    return pad_to_k(ranked, asked, items, k)


def bm25_by_category(items: DataFrame, queries: DataFrame, k: int, policy: str = "hard", text: str = "text", category: str = "category") -> DataFrame:
    """Each category is an index of its own. Queries of an unknown or no category have no rows (hard) or use the index of all (fallback)."""
    if policy not in ("hard", "fallback", "none"):
        raise ValueError(policy)
    if policy == "none":
        return bm25(items, queries, k, text)
    known = items.where(F.col(category).isNotNull()).select(category).distinct()
    inside = queries.join(F.broadcast(known), category, "left_semi")
    ranked = top_k(bm25_scores(items, inside, k, text, (category,)), k)
    asked = inside.where(F.size(plain_words(F.coalesce(F.col(text), F.lit("")))) > 0)
    supply = items.select(category, "item_id").withColumn("__p", row_rank([category], [F.asc("item_id")])).where(F.col("__p") <= k)
    out = pad_to_k(ranked, asked, items, k, eligible=asked.join(supply, category).select("query_id", "item_id"))
    if policy == "hard":
        return out
    return out.unionByName(bm25(items, queries.join(F.broadcast(known), category, "left_anti"), k, text))


def bm25_score(items: DataFrame, queries: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """query_id, item_id, score of given pairs only, 0 where nothing is shared; scored as bm25 ranks."""
    freq, lengths = frequencies(items, text, plain_words), items.agg(F.avg(F.size(plain_words(F.coalesce(F.col(text), F.lit(""))))).alias("avgdl"))
    held = counted(items.join(pairs.select("item_id").distinct(), "item_id", "left_semi"), "item_id", text, plain_words).join(freq, "term").crossJoin(F.broadcast(lengths))
    idf = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    held = held.select("item_id", "term", (idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avgdl")))).alias("weight"))
    asked = pairs.select("query_id", "item_id").distinct().join(counted(queries, "query_id", text, plain_words).select("query_id", "term", F.col("tf").alias("times")), "query_id")
    found = asked.join(held, ["item_id", "term"]).groupBy("query_id", "item_id").agg(F.sum(F.col("times") * F.col("weight")).alias("s"))
    return pairs.select("query_id", "item_id").distinct().join(found, ["query_id", "item_id"], "left").select("query_id", "item_id", rounded(F.coalesce("s", F.lit(0.0))).alias("score"))


def unit_weights(terms: DataFrame, idf: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    raw = terms.join(idf, [*by, "term"]).withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(*by, key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, [*by, key]).select(*by, key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def tfidf_vectors(items: DataFrame, queries: DataFrame, text: str, analyzer: Analyzer, by: tuple[str, ...] = (), min_df: int = 1, max_features: int | None = None, keep: tuple[str, ...] = (), asked_keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Items and queries as vectors of length 1. Weights: 1 + ln tf, times ln((1 + n) / (1 + df)) + 1.

    max_features: only so many terms, the most frequent in the items (by occurrences, ties to the smaller term).
    """
    freq = frequencies(items, text, analyzer, by).where(F.col("df") >= min_df)
    if max_features:
        words = items.select(F.explode(analyzer(F.coalesce(F.col(text), F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
        freq = freq.join(F.broadcast(words.orderBy(F.desc("c"), "word").limit(max_features).select(F.xxhash64("word").alias("term"))), "term", "left_semi")
    idf = freq.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def of(texts: DataFrame, key: str, kept: tuple[str, ...]) -> DataFrame:
        terms = counted(texts, key, text, analyzer, by, kept).join(idf, "term")
        return vectors(terms.select(key, *kept, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw")), key, kept)

    return of(items, "item_id", keep), of(queries, "query_id", asked_keep)


def tfidf(items: DataFrame, queries: DataFrame, k: int, analyzer: Analyzer = lower_words, text: str = "text", pad: bool = True, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """Top k by cosine; padded for every query, empty ones too, if asked."""
    ranked = top_k(best_in_blocks(*tfidf_vectors(items, queries, text, analyzer, min_df=min_df, max_features=max_features), k).drop("block"), k)
    return pad_to_k(ranked, queries, items, k) if pad else ranked


def tfidf_by_category(items: DataFrame, queries: DataFrame, k: int, analyzer: Analyzer = lower_words, text: str = "text", category: str = "category") -> DataFrame:
    inside = queries.join(F.broadcast(items.where(F.col(category).isNotNull()).select(category).distinct()), category, "left_semi")
    ranked = top_k(best_in_blocks(*tfidf_vectors(items, inside, text, analyzer, (category,)), k).drop("block"), k)
    supply = items.select(category, "item_id").withColumn("__p", row_rank([category], [F.asc("item_id")])).where(F.col("__p") <= k)
    return pad_to_k(ranked, inside, items, k, eligible=inside.join(supply, category).select("query_id", "item_id"))


def tfidf_routed(items: DataFrame, queries: DataFrame, allowed: DataFrame, k: int, analyzer: Analyzer = lower_words, text: str = "text", fallback_k: int = 0, pad: bool = True) -> DataFrame:
    """Items of the allowed routes only (idf of all items), padded inside them; then, after them, up to fallback_k others.

    items: item_id, route, text. allowed: query_id, route. The fallback takes the best items outside the routes, then
    the first of the whole corpus by id that the list lacks. `block` tells the two apart: the list isn't in order of score as a whole.
    """
    routes = allowed.select("query_id", "route").distinct()
    lists = routes.groupBy("query_id").agg(F.collect_list(F.col("route").cast("string")).alias("routes"))
    held, asked = tfidf_vectors(items, queries, text, analyzer, keep=("route",))
    found = best_in_blocks(held, asked.join(lists, "query_id", "left"), k, fallback_k)
    # both blocks are ranked in one exchange
    found = top_k(found, max(k, fallback_k), by=("query_id", "block")).where(F.col("rank") <= F.when(F.col("block") == 1, k).otherwise(fallback_k))
    inside = found.where("block = 1").drop("block")
    supply = items.select("route", "item_id").withColumn("__p", row_rank(["route"], [F.asc("item_id")])).where(F.col("__p") <= k)
    eligible = routes.join(supply, "route").select("query_id", "item_id")
    first = pad_to_k(inside, queries, items, k, eligible=eligible) if pad else inside.select("query_id", "item_id", "score", "rank")
    first = first.withColumn("block", F.lit(1))
    if not fallback_k:
        return first
    second = found.where("block = 2").select("query_id", "item_id", "score")
    taken = first.select("query_id", "item_id").unionByName(second.select("query_id", "item_id"))
    smallest = F.broadcast(items.select("item_id").distinct().orderBy("item_id").limit(k + fallback_k))
    pads = queries.select("query_id").crossJoin(smallest).join(taken, ["query_id", "item_id"], "left_anti").withColumn("score", F.lit(0.0))
    both = second.withColumn("p", F.lit(0)).unionByName(pads.withColumn("p", F.lit(1)))
    both = both.withColumn("rank", row_rank(["query_id"], [F.asc("p"), F.desc("score"), F.asc("item_id")])).where(F.col("rank") <= fallback_k).drop("p")
    n = first.groupBy("query_id").agg(F.count("*").alias("n"))
    tail = both.join(n, "query_id", "left").withColumn("rank", (F.col("rank") + F.coalesce("n", F.lit(0))).cast("int")).drop("n").withColumn("block", F.lit(2))
    return first.unionByName(tail.select(first.columns))


#: Branches of a field index: the fields, the analyzer, and whether an empty query text leaves the branch out.
BRANCHES: dict[str, tuple[tuple[str, ...], Analyzer, bool]] = {
    "A": (("title",), word_12, False),
    "B": (("title", "params"), char_wb_35, False),
    "C": (("description",), word_12, False),
    "D": (("params",), word_12, True),
}


#: Other names of the branches. Fixed values.
BRANCH_NAMES = {
    "A": ("a", "branch_a", "query_title", "title"),
    "B": ("b", "branch_b", "query_title_params", "title_params"),
    "C": ("c", "branch_c", "query_description", "description"),
    "D": ("d", "branch_d", "filters_params", "params"),
}


def branch_of(name: str) -> str:
    """The branch that a name means, in any case."""
    for branch, names in BRANCH_NAMES.items():
        if name.strip().lower() in names:
            return branch
    raise ValueError(f"unknown branch {name!r}")


def field_branch(items: DataFrame, queries: DataFrame, branch: str, k: int, query_text: str = "text") -> DataFrame:
    """One branch of the field-aware index, as source <branch>, without padding."""
    branch = branch_of(branch)
    fields, analyzer, needs_text = BRANCHES[branch]
    texts = items.select("item_id", F.concat_ws(" ", *(tx.normalize(f) for f in fields)).alias("text"))
    asked = queries.where(tx.normalize(query_text) != "") if needs_text else queries
    return tfidf(texts, asked.select("query_id", F.col(query_text).alias("text")), k, analyzer, pad=False).withColumn("source", F.lit(branch))


def multi_branch(items: DataFrame, queries: DataFrame, k: int, texts: dict[str, str]) -> DataFrame:
    """All branches named in `texts` (a branch by any of its names, to the column of its query text); a branch is asked once."""
    wanted = {branch_of(name): column for name, column in texts.items()}
    if len(wanted) < len(texts):
        raise ValueError("two names of one branch")
    return union(*(field_branch(items, queries, branch, k, column) for branch, column in sorted(wanted.items())))


def numeric_overlap(items: DataFrame, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Shared distinct numbers over the query's numbers; queries without a number have no rows."""
    numbers = F.array_sort(F.transform(tx.canonical_numbers(text), lambda x: F.xxhash64(x))).alias("terms")
    held = items.select("item_id", numbers).where(F.size("terms") > 0).withColumn("weights", F.transform("terms", lambda x: F.lit(1.0)))
    asked = queries.select("query_id", numbers).where(F.size("terms") > 0).withColumn("weights", F.transform("terms", lambda x: 1.0 / F.size("terms")))
    return best_of_distinct(held, asked, k)


def historical_intent(contexts: DataFrame, positives: DataFrame, queries: DataFrame, k: int, neighbours: int = 20) -> DataFrame:
    """Items of the most similar past contexts: sum of similarity over the neighbour's rank.

    contexts: query_id, text; positives: query_id, item_id; queries: query_id, text.
    """
    past = contexts.select(F.col("query_id").alias("item_id"), "text")
    near = tfidf(past, queries, neighbours, char_wb_35, pad=False, min_df=2).select("query_id", F.col("item_id").alias("past_id"), "score", "rank")
    gained = near.join(positives.select(F.col("query_id").alias("past_id"), "item_id").distinct(), "past_id")
    return top_k(gained.groupBy("query_id", "item_id").agg(rounded(F.sum(F.col("score") / F.col("rank"))).alias("score")), k)


def history_replay(train: DataFrame, queries: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Items chosen under the same text before, by how often."""
    counts = train.groupBy(text, "item_id").agg(F.count("*").cast("double").alias("score"))
    return top_k(queries.join(counts, text).select("query_id", "item_id", "score"), k)
