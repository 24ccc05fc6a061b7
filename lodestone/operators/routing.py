"""Routing queries to categories: exact posteriors, fallbacks, blends, a classifier, and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numeric import clipped_log_share, entropy
from lodestone.functions.numeric import score as rounded
from lodestone.operators.candidates import row_rank


def counts(history: DataFrame) -> DataFrame:
    """query, category, n; null queries and categories don't count."""
    return history.where("query is not null and category is not null").groupBy("query", "category").agg(F.count("*").alias("n"))


def prior(history: DataFrame, k: int | None = None) -> DataFrame:
    """category, n, rank over all queries: count, then category."""
    total = history.where("query is not null and category is not null").groupBy("category").agg(F.count("*").alias("n"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), F.asc("category"))))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def posterior_probabilities(history: DataFrame, queries: DataFrame, k: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, category, probability, rank of seen queries."""
    c = counts(history)
    share = c.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("query"))).withColumn("rank", row_rank(["query"], [F.desc("n"), F.asc("category")]))
    p = F.col("probability")
    return queries.join(share if k is None else share.where(F.col("rank") <= k), "query").select("query_id", "category", (p if exact else rounded(p)).alias("probability"), "rank")


def support(history: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, support, is_seen."""
    n = history.where("query is not null and category is not null").groupBy("query").agg(F.count("*").alias("n"))
    return queries.join(n, "query", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("support"), F.col("n").isNotNull().alias("is_seen"))


def posterior_top_k(history: DataFrame, queries: DataFrame, k: int, backfill: bool = False) -> DataFrame:
    """query_id, category, rank: a seen query's own categories, an unseen one's from the prior; backfill tops up from it."""
    seen = posterior_probabilities(history, queries, k).select("query_id", "category", "rank")
    general = F.broadcast(prior(history, 2 * k).select("category", F.col("rank").alias("p")))
    known = support(history, queries)
    asked = known.select("query_id") if backfill else known.where(~F.col("is_seen")).select("query_id")
    more = asked.crossJoin(general).join(seen.select("query_id", "category"), ["query_id", "category"], "left_anti")
    rows = seen.select("query_id", "category", F.lit(0).alias("b"), F.col("rank").alias("p")).unionByName(more.select("query_id", "category", F.lit(1).alias("b"), "p"))
    return rows.withColumn("rank", row_rank(["query_id"], [F.asc("b"), F.asc("p")])).where(F.col("rank") <= k).select("query_id", "category", "rank")


def hybrid(history: DataFrame, queries: DataFrame, classifier: DataFrame, k: int, min_count: int = 3, blend: bool = False, alpha: float | None = None) -> DataFrame:
    """query_id, category, probability, rank. classifier: query_id, category, probability.

    Support of min_count or more: the exact posterior. Less, if blending: alpha (or support / min_count) of it and the
    rest of the classifier. Else the classifier, and for queries that it lacks, blending or not, the prior.
    """
    known = support(history, queries)
    exact = posterior_probabilities(history, queries, exact=True).join(known, "query_id")
    sure = exact.where(F.col("support") >= min_count).select("query_id", "category", "probability")
    rest = known.where(F.col("support") < min_count)
    a = F.lit(alpha) if alpha is not None else F.col("support") / F.lit(float(min_count))
    guessed = classifier.join(rest, "query_id")
    if blend:
        mixed = exact.where((F.col("support") < min_count) & (F.col("support") > 0)).join(classifier.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "category", (a * F.col("probability")).alias("probability"))
        guessed = guessed.withColumn("probability", F.when(F.col("support") > 0, (1 - a) * F.col("probability")).otherwise(F.col("probability"))).select("query_id", "category", "probability")
        guessed = guessed.unionByName(mixed).groupBy("query_id", "category").agg(F.sum("probability").alias("probability"))
    else:
        guessed = guessed.select("query_id", "category", "probability")
    lacking = rest.join(classifier.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    # the k first of the prior are all that a query can get of it; so many rows are broadcast
    total = prior(history).withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).where(F.col("rank") <= k).select("category", "probability")
    out = sure.unionByName(guessed).unionByName(lacking.crossJoin(F.broadcast(total))).withColumn("probability", rounded(F.col("probability")))
    return out.withColumn("rank", row_rank(["query_id"], [F.desc("probability"), F.asc("category")])).where(F.col("rank") <= k)


def context_weights(history: DataFrame) -> DataFrame:
    """query, category, n, weight: how sure a context is of a category, in [0.1, 1]."""
    c = counts(history)
    return c.withColumn("weight", rounded(clipped_log_share(F.col("n"), F.sum("n").over(Window.partitionBy("query")))))


def expand(routes: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, item_id of all items in the routes."""
    return routes.select("query_id", "category").join(items.select("item_id", "category"), "category").select("query_id", "item_id")


#: How sure a query's probabilities are, by name; more is surer.
CONFIDENCE = {
    "top1": lambda p: F.element_at(p, 1),
    "margin": lambda p: F.element_at(p, 1) - F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(0.0)),
    "entropy": lambda p: -entropy(p),
}


def adaptive_k(routes: DataFrame, ks: tuple[int, int, int] = (15, 10, 5), shares: tuple[float, float] = (0.333, 0.667), signal: str = "top1", unseen: DataFrame | None = None) -> DataFrame:
    """Fewer routes for queries that are surer: tertiles of the signal pick each query's k (5 to 15, or 8 to 12).

    signal: the best probability, its margin over the second, or entropy (less is surer). unseen: query_id of those whose tertiles count, else all.
    A query at the lower edge is unsure, one at the upper edge middling.
    """
    sorted_p = F.sort_array(F.collect_list("probability"), asc=False)
    best = routes.groupBy("query_id").agg(sorted_p.alias("p")).select("query_id", rounded(CONFIDENCE[signal](F.col("p"))).alias("best"))
    measured = best if unseen is None else best.join(unseen.select("query_id"), "query_id", "left_semi")
    edges = measured.agg(F.percentile("best", F.array(*map(F.lit, shares))).alias("e"))
    k = F.when(F.col("best") <= F.col("e")[0], ks[0]).when(F.col("best") <= F.col("e")[1], ks[1]).otherwise(ks[2])
    chosen = best.crossJoin(F.broadcast(edges)).select("query_id", k.alias("k"))
    return routes.join(chosen, "query_id").where(F.col("rank") <= F.col("k"))


def containment(routes: DataFrame, truth: DataFrame) -> DataFrame:
    """segment, item_containment: the mean share of a query's items whose category is among its routes. truth: query_id, item_id, category, is_seen."""
    marked = truth.join(routes.select("query_id", "category", F.lit(1.0).alias("in_route")).distinct(), ["query_id", "category"], "left")
    each = marked.groupBy("query_id", "is_seen").agg(F.avg(F.coalesce("in_route", F.lit(0.0))).alias("share"))
    sets = each.rollup("is_seen").agg(rounded(F.avg("share")).alias("item_containment"), F.grouping("is_seen").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "overall").when(F.col("is_seen"), "seen").otherwise("unseen").alias("segment"), "item_containment")


def routing_grid(routes: DataFrame, truth: DataFrame, sizes: DataFrame, ks: Sequence[int]) -> DataFrame:
    """For each k: the share of queries with a true category among the first k routes, and the sum of their categories' sizes: mean, interpolated median and p95, least, most.

    routes: query_id, category, rank. truth: query_id, category. sizes: category, n.
    """
    cut = routes.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))))
    size = cut.join(sizes, "category", "left").groupBy("query_id", "k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"))
    hit = cut.join(truth.select("query_id", "category").distinct(), ["query_id", "category"], "left_semi").select("query_id", "k").distinct().withColumn("hit", F.lit(1.0))
    every = truth.select("query_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks)))).join(size, ["query_id", "k"], "left").join(hit, ["query_id", "k"], "left")
    every = every.select("k", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
    return every.groupBy("k").agg(rounded(F.avg("hit")).alias("containment"), rounded(F.avg("size")).alias("mean_size"), rounded(F.percentile("size", F.lit(0.5))).alias("p50_size"), rounded(F.percentile("size", F.lit(0.95))).alias("p95_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))


def evaluate(routes: DataFrame, truth: DataFrame, sizes: DataFrame) -> DataFrame:
    """segment, category_hit, corpus sizes: mean, upper median, p95, max, and share of the corpus.

    routes: query_id, category; truth: query_id, category, is_seen; sizes: category, n. Medians are the element at
    n // 2, p95 that at n * 95 // 100, of sorted sizes.
    """
    size = routes.join(F.broadcast(sizes), "category", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"))
    hit = truth.join(routes.select("query_id", "category", F.lit(1.0).alias("hit")), ["query_id", "category"], "left").groupBy("query_id", "is_seen").agg(F.max(F.coalesce("hit", F.lit(0.0))).alias("hit"))
    each = hit.join(size, "query_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    total = sizes.agg(F.sum("n").alias("total"))
    # sizes take few values (sums of whole categories), so they are counted before they are put in order
    tally = each.groupBy("is_seen", "size").agg(F.count("*").alias("c"), F.sum("hit").alias("h"))
    both = tally.withColumn("segment", F.explode(F.array(F.lit("overall"), F.when(F.col("is_seen"), "seen").otherwise("unseen")))).groupBy("segment", "size").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))
    w = Window.partitionBy("segment")
    ordered = both.withColumns({"upto": F.sum("c").over(w.orderBy("size")), "n": F.sum("c").over(w)})
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("size")))
    n = F.col("n")
    out = ordered.groupBy("segment").agg(
        F.first("n").alias("queries"), rounded(F.sum("h") / F.sum("c")).alias("category_hit"), rounded(F.sum(F.col("size") * F.col("c")) / F.sum("c")).alias("mean_size"),
        at(F.floor(n / 2)).alias("median_size"), at(F.least(n - 1, F.floor(n * 95 / 100))).alias("p95_size"), F.max("size").alias("max_size"))
    return out.crossJoin(F.broadcast(total)).withColumn("route_fraction", rounded(F.col("mean_size") / F.col("total"))).drop("total")


def classifier_routes(train: DataFrame, queries: DataFrame, k: int, features: int = 50_000, regularization: float = 1e-4, iterations: int = 25, weight: str | None = None) -> DataFrame:
    """query_id, category, probability, rank from a multinomial logistic model on TF-IDF of two blocks, each of length 1.

    train: text, category. The blocks are words with their pairs and characters' 3- to 5-grams inside words; each has the
    `features` terms used most, by their own names. Equal rows are one with a weight, and count as often as they occur.
    The reference's stochastic solver is replaced by Spark's: numbers differ.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors, VectorUDT

    from lodestone.operators import lexical

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    classes = [r.category for r in train.select("category").distinct().limit(2).collect()]
    if len(classes) < 2:  # nothing to tell apart: the one class is sure
        alone = queries.select("query_id").withColumns({"category": F.lit(classes[0] if classes else None).cast(train.schema["category"].dataType), "probability": F.lit(1.0), "rank": F.lit(1)})
        return alone if classes else alone.limit(0)

    def blocks(texts: DataFrame, *keep: str) -> DataFrame:
        word, char = (lexical.postings(texts, "text", "text", analyzer, keep).withColumn("block", F.lit(n)) for n, analyzer in enumerate((lexical.word_12, lexical.char_wb_35)))
        return word.unionByName(char)

    pairs = train.select(text, "category", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).groupBy("text", "category").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    texts = pairs.groupBy("text").agg(F.sum("n").alias("n"))
    used = blocks(texts, "n").groupBy("block", "term").agg(F.sum("n").alias("df"), F.sum(F.col("n") * F.col("tf")).alias("uses"))
    kept = used.withColumn("place", row_rank(["block"], [F.desc("uses"), F.asc("term")])).where(F.col("place") <= features)
    total = F.broadcast(texts.agg(F.sum("n").alias("n")))
    idf = kept.crossJoin(total).select("block", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    # of bounded size, and read several times by what follows: as rows, so that plans don't repeat how it was made
    named = [(*r, n) for n, r in enumerate(sorted(idf.collect()))]
    vocabulary, width = train.sparkSession.createDataFrame(named, "block int, term string, idf double, place int"), max(1, len(named))
    vector = F.udf(lambda cells: Vectors.sparse(width, [tuple(c) for c in cells or ()]), VectorUDT())

    def vectors(texts: DataFrame) -> DataFrame:
        weights = lexical.unit_weights(blocks(texts), vocabulary.select("block", "term", "idf"), "text", ("block",)).join(vocabulary.select("block", "term", "place"), ["block", "term"])
        cells = weights.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("cells"))
        return texts.join(cells, "text", "left").select("text", vector("cells").alias("features"))

    indexer = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(pairs)
    model = LogisticRegression(maxIter=iterations, regParam=regularization, weightCol="w").fit(indexer.transform(pairs).join(vectors(texts.select("text")), "text"))
    asked = queries.select("query_id", text)
    scored = model.transform(asked.join(vectors(asked.select("text").distinct()), "text")).select("query_id", F.posexplode(vector_to_array("probability")).alias("label", "probability"))
    named = IndexToString(inputCol="label", outputCol="category", labels=indexer.labels).transform(scored.withColumn("label", F.col("label").cast("double")))
    return named.withColumn("rank", row_rank(["query_id"], [F.desc("probability"), F.asc("category")])).where(F.col("rank") <= k).select("query_id", "category", "probability", "rank")


def posterior_k_grid(history: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Routes for several k at once."""
    routes = posterior_top_k(history, queries, max(ks))
    return routes.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))))
