"""Recall, coverage, slices, comparisons. A query of the ground truth that has no prediction counts 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numeric import score as rounded
from lodestone.operators.contracts import SchemaError


def cutoffs(candidates: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Each row once for every k that its rank is within."""
    return candidates.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))))


def query_recall(candidates: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, query_id, relevant, hits, recall for every query of the truth."""
    relevant = truth.groupBy("query_id").agg(F.count_distinct("item_id").alias("relevant"))
    hits = cutoffs(candidates.join(truth.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi"), ks).groupBy("query_id", "k").agg(F.count_distinct("item_id").alias("hits"))
    every = relevant.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return every.join(hits, ["query_id", "k"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("recall", F.col("hits") / F.col("relevant"))


def same_label_recall(candidates: DataFrame, labels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, recall, queries, as recall_at where an id's truth are all other ids that share a label with it; ids without such have no part.

    labels: id, label, which an id may have more of. Pairs of the truth never become rows: ids of the same labels are a class, and classes are counted.
    """
    ids = labels.groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels")).where(F.size("labels") > 0)
    classes = ids.groupBy("labels").agg(F.count("*").alias("n"))
    one = classes.select("labels", F.explode("labels").alias("label"))
    other = classes.select(F.col("labels").alias("others"), F.explode("labels").alias("label"), "n")
    sizes = one.join(other, "label").select("labels", "others", "n").distinct().groupBy("labels").agg((F.sum("n") - 1).alias("relevant"))
    relevant = ids.join(sizes, "labels").where(F.col("relevant") > 0).select(F.col("id").alias("query_id"), "relevant")
    pairs = cutoffs(candidates.where(F.col("query_id") != F.col("item_id")), ks).select("query_id", "item_id", "k").distinct()
    met = pairs.join(ids.select(F.col("id").alias("query_id"), F.col("labels").alias("a")), "query_id").join(ids.select(F.col("id").alias("item_id"), F.col("labels").alias("b")), "item_id")
    hits = met.where(F.arrays_overlap("a", "b")).groupBy("query_id", "k").agg(F.count("*").alias("hits"))
    every = relevant.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).join(hits, ["query_id", "k"], "left")
    return every.groupBy("k").agg(rounded(F.avg(F.coalesce("hits", F.lit(0)) / F.col("relevant"))).alias("recall"), F.count("*").alias("queries"))


def recall_at(candidates: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Mean over the queries of the truth; with several sources this is the coverage of their union."""
    return query_recall(candidates, truth, ks).groupBy("k").agg(rounded(F.avg("recall")).alias("recall"), F.count("*").alias("queries"))


def ranking_metrics(candidates: DataFrame, truth: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, recall over the queries given; no ground truth at all, or a query without any, is an error."""
    if truth.isEmpty():
        raise SchemaError("empty ground truth")
    if not queries.join(truth, "query_id", "left_anti").isEmpty():
        raise SchemaError("a query without ground truth")
    return recall_over_queries(candidates, truth.join(queries.select("query_id").distinct(), "query_id", "left_semi"), queries, ks)


def recall_over_queries(candidates: DataFrame, truth: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Mean over the queries given; one without truth scores 0."""
    each = query_recall(candidates, truth, ks)
    every = queries.select("query_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return every.join(each, ["query_id", "k"], "left").groupBy("k").agg(rounded(F.avg(F.coalesce("recall", F.lit(0.0)))).alias("recall"), F.count("*").alias("queries"))


def recovered(base: DataFrame, more: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: pairs of the truth that `more` has within k and `base` hasn't."""
    pairs = truth.select("query_id", "item_id").distinct()
    hit = lambda c: pairs.join(c.where(F.col("rank") <= k).select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
    return hit(more).exceptAll(hit(base)).agg(F.count("*").alias("recovered"))


def incremental_coverage(base: DataFrame, more: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Recall that a source adds to others, not below 0."""
    before = recall_at(base, truth, ks).select("k", F.col("recall").alias("base_recall"))
    after = recall_at(base.unionByName(more), truth, ks).select("k", F.col("recall").alias("union_recall"))
    return before.join(after, "k").withColumn("gain", rounded(F.greatest(F.lit(0.0), F.col("union_recall") - F.col("base_recall"))))


def unique_contributions(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per source: hits within k, and hits that no other source has."""
    hits = candidates.where(F.col("rank") <= k).join(truth.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi").select("query_id", "item_id", "source").distinct()
    n = F.count("*").over(Window.partitionBy("query_id", "item_id"))
    return hits.withColumn("n", n).groupBy("source").agg(F.count("*").alias("hits"), F.count_if(F.col("n") == 1).alias("unique_hits"))


def slice_recall(candidates: DataFrame, truth: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """slices: query_id, slice. Recall and queries of each slice; null slices don't count."""
    each = query_recall(candidates, truth, [k])
    return each.join(slices.where("slice is not null"), "query_id").groupBy("slice").agg(rounded(F.avg("recall")).alias("recall"), F.count("*").alias("queries"))


def seen_and_overall(candidates: DataFrame, truth: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Overall, seen and unseen recall in one pass of grouping sets. seen: query_id, is_seen."""
    each = query_recall(candidates, truth, [k]).join(seen, "query_id")
    sets = each.rollup("is_seen").agg(rounded(F.avg("recall")).alias("recall"), F.count("*").alias("queries"), F.grouping("is_seen").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "overall").when(F.col("is_seen"), "seen").otherwise("unseen").alias("segment"), "recall", "queries")


def proxy_score(candidates: DataFrame, truth: DataFrame, seen: DataFrame, k: int, weights: tuple[float, float] = (0.35, 0.65)) -> DataFrame:
    each = query_recall(candidates, truth, [k]).join(seen, "query_id")
    mean = lambda flag: F.coalesce(F.avg(F.when(F.col("is_seen") == flag, F.col("recall"))), F.lit(0.0))
    return each.agg(rounded(weights[0] * mean(True) + weights[1] * mean(False)).alias("proxy"))


def monotonic(metrics: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """k, recall and whether it is no lower than at the k before. A handful of rows: one for each k."""
    return metrics.withColumn("ok", F.coalesce(F.col("recall") + tolerance >= F.lag("recall").over(Window.orderBy("k")), F.lit(True)))


def hit_quadrants(one: DataFrame, other: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Pairs of the truth by whether each of two rankings has them within k."""
    flag = lambda c, name: c.where(F.col("rank") <= k).select("query_id", "item_id", F.lit(True).alias(name)).distinct()
    marked = truth.select("query_id", "item_id").distinct().join(flag(one, "a"), ["query_id", "item_id"], "left").join(flag(other, "b"), ["query_id", "item_id"], "left")
    a, b = (F.coalesce(F.col(c), F.lit(False)) for c in "ab")
    return marked.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"))


def rank_buckets(candidates: DataFrame, truth: DataFrame, edges: Sequence[int]) -> DataFrame:
    """Pairs of the truth by their best rank: up to each edge, beyond the last, or missing."""
    best = candidates.groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
    found = truth.select("query_id", "item_id").distinct().join(best, ["query_id", "item_id"], "left")
    name = F.when(F.col("rank").isNull(), "missing")
    for e in edges:
        name = name.when(F.col("rank") <= e, f"<={e}")
    return found.groupBy(name.otherwise(f">{edges[-1]}").alias("bucket")).agg(F.count("*").alias("pairs"))


def source_overlap(candidates: DataFrame, k: int) -> DataFrame:
    """Jaccard of the sources' pairs within k. Sources are few; each pair of the relation meets only its own other sources."""
    pairs = candidates.where(F.col("rank") <= k).groupBy("query_id", "item_id").agg(F.array_sort(F.collect_set("source")).alias("s"))
    single = pairs.select(F.explode("s").alias("source")).groupBy("source").count()
    both = pairs.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    size = lambda c: F.broadcast(single.select(F.col("source").alias(c), F.col("count").alias(f"n_{c}")))
    return both.join(size("a"), "a").join(size("b"), "b").select("a", "b", "both", rounded(F.col("both") / F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def bootstrap_means(per_query: DataFrame, value: str, replicates: int = 200, seed: int = 42) -> DataFrame:
    """Mean, 2.5 and 97.5 % of the replicates' means, and the share of these that isn't over 0 (a one-sided p where the value is a gain): Poisson weights drawn from a hash of query and replicate."""
    weighted = per_query.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", (F.pmod(F.xxhash64("query_id", "replicate", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30))
    edges, total, term = [], 0.0, 0.36787944117144233
    for n in range(8):
        total += term
        edges.append(total)
        term /= n + 1
    weight = sum((F.col("u") > e).cast("int") for e in edges)
    means = weighted.groupBy("replicate").agg((F.sum(weight * F.col(value)) / F.greatest(F.sum(weight), F.lit(1))).alias("m"))
    low_high = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.avg((F.col("m") <= 0).cast("double")).alias("p_not_positive"))
    return per_query.agg(F.avg(value).alias("mean")).crossJoin(F.broadcast(low_high)).select("mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "p_not_positive")
