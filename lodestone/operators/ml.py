"""Learned parts: a selector over pair features, a hashed two-tower encoder, re-ranking by a scorer."""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.candidates import top_k
from lodestone.operators.settle import staged

KEYS = ("query_id", "item_id", "label", "fold", "split")


def feature_columns(df: DataFrame) -> list[str]:
    """The numeric columns but the keys."""
    return [n for n, t in df.dtypes if n not in KEYS and t in ("int", "bigint", "double", "float", "tinyint", "smallint")]


def train_selector(table: DataFrame, features: Sequence[str] | None = None, trees: int = 20, depth: int = 4, seed: int = 42):
    """Boosted trees on label 0 or 1; stands for the reference's own booster.

    Every row counts: rows of equal features and label are one instance, of their number's weight, which is the same to a tree.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(features or feature_columns(table))
    stages = [VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, labelCol="label", weightCol="__times")]
    instances = distinct_instances(table, names).persist()  # read again for each level of each tree
    try:
        return Pipeline(stages=stages).fit(instances)
    finally:
        instances.unpersist()


def distinct_instances(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """The distinct features and labels, and how often each occurs (__times)."""
    return table.groupBy(*names, F.col("label").cast("double").alias("label")).agg(F.count("*").cast("double").alias("__times"))


def score_selector(model, table: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(table).withColumn("final_score", F.round(vector_to_array("probability")[1], 9)).drop("features", "rawPrediction", "probability", "prediction")


def rank_with_selector(model, table: DataFrame, limit: int = 50) -> DataFrame:
    return top_k(score_selector(model, table), limit, "final_score")


def save_selector(model, folder: str) -> None:
    model.write().overwrite().save(folder)


def load_selector(folder: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(folder)


def rank_out_of_fold(table: DataFrame, limit: int = 50, folds: int = 5, seed: int = 42, features: Sequence[str] | None = None, trees: int = 20, depth: int = 4) -> DataFrame:
    """query_id, item_id, fold, final_score, rank: each fold of the queries ranked by a model that saw only the others.

    Queries are whole in a fold. A pairwise ranking loss has no counterpart here: the model is pointwise, on features that are also taken relative to
    their query (the difference to its mean), so that it learns order within a query.
    """
    from lodestone.functions.ids import hash_bucket

    names = list(features or feature_columns(table))
    within = Window.partitionBy("query_id")
    fold = hash_bucket(F.concat(F.lit(f"{seed}:"), "query_id"), folds).alias("fold")
    wide = staged(table.select("query_id", "item_id", "label", *names, *((F.col(n) - F.avg(n).over(within)).alias(f"{n}_within") for n in names), fold), "fold")
    used, out = [*names, *(f"{n}_within" for n in names)], None
    for n in range(folds):
        model = train_selector(wide.where(F.col("fold") != n), used, trees, depth, seed)
        one = rank_with_selector(model, wide.where(F.col("fold") == n), limit).select("query_id", "item_id", "fold", "final_score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def rerank(pairs: DataFrame, scorer: Callable[[list[str], list[str]], Sequence[float]], limit: int = 50) -> DataFrame:
    """query_id, item_id, query_text, item_text through a scorer of text pairs, in Arrow batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = scorer(b.column("query_text").to_pylist(), b.column("item_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("item_id"), pa.array(np.asarray(scores, float))], names=["query_id", "item_id", "rerank_score"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "item_id"))
    return top_k(pairs.select("query_id", "item_id", "query_text", "item_text").mapInArrow(run, f"{kinds}, rerank_score double"), limit, "rerank_score")


def token_ids(text: str, vocabulary: int) -> list[int]:
    """Tokens to 1 .. vocabulary - 1 by BLAKE2b; 0 stands for none."""
    words = re.findall(r"\w+", text.lower())
    return [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % (vocabulary - 1) + 1 for w in words] or [0]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def token_id_column(text: pd.Series, vocabulary: pd.Series) -> pd.Series:
    return pd.Series([token_ids(t or "", int(v)) for t, v in zip(text, vocabulary, strict=True)])


@dataclass
class TwoTower:
    """Mean of hashed token vectors, a linear map and tanh, at length 1; one map for each side."""

    vocabulary: int = 4096
    width: int = 32
    dimension: int = 32
    seed: int = 42
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            r = np.random.default_rng(self.seed)
            self.weights = {"tokens": r.normal(0, 0.1, (self.vocabulary, self.width)), "query": r.normal(0, 0.3, (self.width, self.dimension)), "item": r.normal(0, 0.3, (self.width, self.dimension))}

    def means(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([self.weights["tokens"][token_ids(t, self.vocabulary)].mean(0) for t in texts]) if len(texts) else np.zeros((0, self.width))

    def encode(self, texts: Sequence[str], side: str) -> np.ndarray:
        out = np.tanh(self.means(texts) @ self.weights[side])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Settings and arrays, in two files under the folder, on any file system that Spark writes."""
        from lodestone.sources.tables import write_bytes, write_json

        held = io.BytesIO()
        np.savez(held, **self.weights)
        write_bytes(spark, held.getvalue(), f"{folder}/weights.npz")
        write_json({"vocabulary": self.vocabulary, "width": self.width, "dimension": self.dimension, "seed": self.seed}, f"{folder}/model.json", spark)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TwoTower:
        from lodestone.sources.tables import read_bytes, read_json

        with np.load(io.BytesIO(read_bytes(spark, f"{folder}/weights.npz"))) as held:
            model = cls(**read_json(f"{folder}/model.json", spark), weights={k: held[k] for k in held.files})
        for name, shape in (("tokens", (model.vocabulary, model.width)), ("query", (model.width, model.dimension)), ("item", (model.width, model.dimension))):
            if model.weights.get(name, np.zeros(0)).shape != shape:
                raise ValueError(f"{folder}: weights of {name} aren't {shape}")
        return model

    def encoder(self, side: str) -> Callable[[list[str]], np.ndarray]:
        return lambda texts: self.encode(texts, side)


def positive_mask(queries: Sequence[str], items: Sequence[str], pairs: set[tuple[str, str]]) -> np.ndarray:
    """Which (query, item) of a batch are known positives: they are no negatives of one another."""
    return np.array([[(q, i) in pairs for i in items] for q in queries])


def contrastive_loss(query: np.ndarray, item: np.ndarray, mask: np.ndarray | None = None, temperature: float = 0.07) -> float:
    """In-batch softmax loss of the diagonal; other known positives are left out."""
    logits = query @ item.T / temperature
    if mask is not None:
        logits = np.where(mask & ~np.eye(len(query), dtype=bool), -np.inf, logits)
    top = logits.max(1, keepdims=True)
    return float((top[:, 0] + np.log(np.exp(logits - top).sum(1)) - np.diag(logits)).mean())


def _forward(model: TwoTower, texts: Sequence[str], side: str) -> tuple:
    means = model.means(texts)
    raw = np.tanh(means @ model.weights[side])
    norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    return raw / norm, (texts, side, means, raw, norm)


def _step(model: TwoTower, rate: float, *parts: tuple[np.ndarray, tuple, np.ndarray]) -> None:
    """One gradient step on the maps and the token vectors. parts: unit vectors, what _forward kept of them, the loss by them."""
    tokens, maps = [], []
    for unit, (texts, side, means, raw, norm), d in parts:
        d = (d - unit * (d * unit).sum(1, keepdims=True)) / norm * (1 - raw * raw)
        maps.append((side, means.T @ d))
        for text, g in zip(texts, d @ model.weights[side].T, strict=True):
            ids = token_ids(text, model.vocabulary)
            tokens += [(i, g / len(ids)) for i in ids]
    for side, g in maps:
        model.weights[side] -= rate * g
    np.subtract.at(model.weights["tokens"], [i for i, _ in tokens], rate * np.array([g for _, g in tokens]))


def train_two_tower(model: TwoTower, pairs: Sequence[tuple[str, str]], epochs: int = 5, batch: int = 64, rate: float = 0.5, temperature: float = 0.07, seed: int = 42) -> list[float]:
    """Gradient steps on both maps and the token vectors by the contrastive loss, on a bounded list of (query text, item text); the losses."""
    losses = []
    known = set(pairs)
    for epoch in range(epochs):
        order = np.random.default_rng(seed + epoch).permutation(len(pairs))
        for at in range(0, len(order), batch):
            part = [pairs[i] for i in order[at : at + batch]]
            if len(part) < 2:
                continue
            sides = [self_texts for self_texts in zip(*part, strict=True)]
            (q, of_q), (i, of_i) = (_forward(model, t, s) for t, s in zip(sides, ("query", "item"), strict=True))
            mask = positive_mask(sides[0], sides[1], known)
            logits = np.where(mask & ~np.eye(len(part), dtype=bool), -np.inf, q @ i.T / temperature)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.eye(len(part))) / (len(part) * temperature)
            losses.append(contrastive_loss(q, i, mask, temperature))
            _step(model, rate, (q, of_q, g @ i), (i, of_i, g.T @ q))
    return losses


def train_two_tower_with_hard_negatives(model: TwoTower, rows: Sequence[tuple[str, str, Sequence[str]]], epochs: int = 1, batch: int = 32, rate: float = 0.5, temperature: float = 0.07, seed: int = 42) -> list[float]:
    """Gradient steps by the softmax of each row's positive among its own negatives; the losses. rows: query text, item text, texts of negatives."""
    if any(not r[2] for r in rows):
        raise ValueError("each row needs a negative")
    if {(q, n) for q, _, negatives in rows for n in negatives} & {(q, i) for q, i, _ in rows}:
        raise ValueError("a known positive is a negative")
    losses = []
    for epoch in range(epochs):
        order = np.random.default_rng(seed + epoch).permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            owner = np.concatenate([np.arange(len(part)), np.repeat(np.arange(len(part)), [len(r[2]) for r in part])])
            (q, of_q), (i, of_i) = _forward(model, [r[0] for r in part], "query"), _forward(model, [r[1] for r in part] + [n for r in part for n in r[2]], "item")
            logits = (q[owner] * i).sum(1) / temperature
            top = np.full(len(part), -np.inf)
            np.maximum.at(top, owner, logits)
            e = np.exp(logits - top[owner])
            total = np.bincount(owner, e)
            losses.append(float((np.log(total) + top - logits[: len(part)]).mean()))
            g = e / total[owner]
            g[: len(part)] -= 1
            g /= len(part) * temperature
            by_query = np.zeros_like(q)
            np.add.at(by_query, owner, g[:, None] * i)
            _step(model, rate, (q, of_q, by_query), (i, of_i, g[:, None] * q[owner]))
    return losses


cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
