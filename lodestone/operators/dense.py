"""Exact nearest vectors by dot product, over all items or those of a query's routes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocks import best_in_blocks, parts_for
from lodestone.operators.candidates import top_k


def validate_vectors(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """One row: vectors, distinct keys, least and greatest length, vectors with a null or non-finite part."""
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(F.count("*").alias("vectors"), F.count_distinct(key).alias("keys"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("greatest"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))


def exact_top_k(items: DataFrame, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """Each query against every item, by matrix products where blocks of items meet parts of the queries."""
    v = F.col(vector).cast("array<double>").alias("v")
    return top_k(best_in_blocks(items.select("item_id", v), queries.select("query_id", v), k, parts=parts_for(queries.count())).drop("block"), k)


def routed_top_k(items: DataFrame, queries: DataFrame, allowed: DataFrame, k: int, fallback_k: int = 0, vector: str = "embedding") -> DataFrame:
    """Items of the allowed routes only; with a fallback, the best of all that are missing join, and all are ranked by score."""
    v = F.col(vector).cast("array<double>").alias("v")
    lists = allowed.groupBy("query_id").agg(F.collect_set(F.col("route").cast("string")).alias("routes"))
    asked = queries.select("query_id", v).join(lists, "query_id", "left")
    found = best_in_blocks(items.select("item_id", "route", v), asked, max(k, fallback_k), fallback_k)
    inside = top_k(found.where("block = 1").drop("block"), k)
    if not fallback_k:
        return inside
    more = top_k(found.drop("block"), fallback_k).join(inside.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    return top_k(inside.drop("rank").unionByName(more.drop("rank")), k + fallback_k)


def encode(texts: DataFrame, key: str, text: str, encoder, dimension: int) -> DataFrame:
    """key, embedding: an encoder (list of texts to a matrix) in Arrow batches; equal texts are encoded once."""
    distinct = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(encoder(batch.column("text").to_pylist()), np.float64).reshape(batch.num_rows, dimension)
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["text", "embedding"])

    coded = distinct.mapInArrow(run, "text string, embedding array<double>")
    return texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(coded, "text").select(key, "embedding")


def length_sum_encoder(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for a model: length, and sum of code points modulo 97, plus one; at length 1."""
    out = []
    for t in texts:
        v = np.array([len(t), sum(map(ord, t)) % 97 + 1], float)
        out.append((v / np.linalg.norm(v)).tolist())
    return out


cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
