"""Recall over candidates that arrive in batches: the same operators on a stream's micro-batches.

The reference has no streaming engine; it only goes through queries in batches. Here a batch is a micro-batch, and the
totals of all batches so far are kept in a small table: hits and queries by k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.evaluate import query_recall


def batch_totals(candidates: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """k, recall_sum, queries of the queries in the batch."""
    mine = truth.join(candidates.select("query_id").distinct(), "query_id", "left_semi")
    return query_recall(candidates, mine, ks).groupBy("k").agg(F.sum("recall").alias("recall_sum"), F.count("*").alias("queries"))


def stream_recall(candidates: DataFrame, truth: DataFrame, ks: Sequence[int], folder: str, checkpoint: str):
    """Start a query that appends each micro-batch's totals to `folder`; all rows of a query must come in one batch."""

    def add(batch: DataFrame, number: int) -> None:
        batch_totals(batch, truth, ks).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return candidates.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_recall(totals: DataFrame, truth: DataFrame) -> DataFrame:
    """k, recall over all queries of the truth; queries that no batch had count 0."""
    n = truth.agg(F.count_distinct("query_id").alias("n"))
    return totals.groupBy("k").agg(F.sum("recall_sum").alias("s")).crossJoin(F.broadcast(n)).select("k", F.round(F.col("s") / F.col("n"), 9).alias("recall"))
