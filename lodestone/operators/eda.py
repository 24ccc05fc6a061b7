"""Profiles, shares, quantiles, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numeric import score as rounded


def table_profile(df: DataFrame) -> DataFrame:
    """One row: rows, nulls of each column, rows that repeat another in full."""
    repeated = df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    return df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns)).crossJoin(repeated)


def volume_quantiles(train: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, rows_per_query, items_per_query: exact, with linear interpolation."""
    each = train.groupBy("query_id").agg(F.count("*").alias("rows"), F.count_distinct("item_id").alias("items"))
    at = F.array(*map(F.lit, shares))
    both = each.agg(F.percentile("rows", at).alias("r"), F.percentile("items", at).alias("i"))
    return both.select(F.explode(F.arrays_zip(at.alias("share"), F.col("r"), F.col("i"))).alias("x")).select(F.col("x.share").alias("share"), rounded(F.col("x.r")).alias("rows_per_query"), rounded(F.col("x.i")).alias("items_per_query"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: count, mean, sample deviation, least, greatest and percentiles."""
    shares = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    aggs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), rounded(F.avg(c)).alias("mean"), rounded(F.stddev_samp(c)).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.percentile(c, F.array(*map(F.lit, shares))).alias("p")).alias(f"c{k}") for k, c in enumerate(columns)]
    rows = df.agg(*aggs).select(F.explode(F.array(*(f"c{k}" for k in range(len(columns))))).alias("x"))
    return rows.select("x.column", "x.n", "x.mean", "x.std", "x.min", "x.max", *(rounded(F.col("x.p")[k]).alias(f"p{round(100 * s):02d}") for k, s in enumerate(shares)))


def value_shares(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """value, n, share: most frequent first."""
    total = df.agg(F.count("*").alias("t"))
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("value", "n", rounded(F.col("n") / F.col("t")).alias("share"))
    return counted if limit is None else counted.orderBy(F.desc("n"), F.asc("value")).limit(limit)


def top_share(train: DataFrame, n: int = 50) -> DataFrame:
    """One row: share of the rows that belong to the n most frequent items."""
    counts = train.groupBy("item_id").agg(F.count("*").alias("c"))
    best = counts.orderBy(F.desc("c"), F.asc("item_id")).limit(n).agg(F.sum("c").alias("b"))
    return best.crossJoin(counts.agg(F.sum("c").alias("t"), F.count("*").alias("items"))).select(rounded(F.col("b") / F.col("t")).alias("top_share"), F.col("t").alias("rows"), "items")


def drift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: total variation and Jensen-Shannon divergence (bits) of two columns' shares."""
    share = lambda df, name: df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(df.agg(F.count("*").alias("t")))).select("v", (F.col("n") / F.col("t")).alias(name))
    both = share(a, "p").join(share(b, "q"), "v", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(F.lit(0.0))
    return both.agg(rounded(0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("total_variation"), rounded(0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q"))).alias("js_bits"))


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: the greatest distance of two empirical distributions. Values are counted before they are put in order."""
    count = lambda df, x, y: df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).select("v", (F.col("n") * x).alias("a"), (F.col("n") * y).alias("b"))
    both = count(a, 1, 0).unionByName(count(b, 0, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # ranges of values: totals of whole ranges come from one small table, so no task orders all values
    edges = both.agg(F.percentile_approx("v", F.array(*(F.lit(k / 64) for k in range(1, 64))), 1000).alias("e"))
    placed = both.crossJoin(F.broadcast(edges)).withColumn("r", F.size(F.filter("e", lambda x: x < F.col("v")))).drop("e")
    totals = placed.groupBy("r").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    before = totals.select("r", *((F.sum(c).over(Window.orderBy("r")) - F.col(c)).alias(f"before_{c}") for c in "ab"))
    w = Window.partitionBy("r").orderBy("v")
    running = placed.join(F.broadcast(before), "r").select((F.col("before_a") + F.sum("a").over(w)).alias("a"), (F.col("before_b") + F.sum("b").over(w)).alias("b"))
    whole = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    return running.crossJoin(F.broadcast(whole)).agg(rounded(F.max(F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb")))).alias("ks"))


def quantile_delta(a: DataFrame, b: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    at = F.array(*map(F.lit, shares))
    both = a.agg(F.percentile(column, at).alias("x")).crossJoin(b.agg(F.percentile(column, at).alias("y")))
    return both.select(F.explode(F.arrays_zip(at.alias("share"), F.col("x"), F.col("y"))).alias("z")).select(F.col("z.share").alias("share"), rounded(F.col("z.y") - F.col("z.x")).alias("delta"))
