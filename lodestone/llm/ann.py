"""Operator 7, approximate nearest neighbours: cross-polytope hashing with exact reranking.

Each of TABLES tables has a fast pseudo-rotation, three rounds of random signs and a Walsh-Hadamard transform; a
vector's bucket is its nearest signed axis (Andoni et al., 2015). A query probes the PROBES buckets whose axes are
nearest to it. Vectors go to their bucket in each table with the query vectors that probe it, and the inner products are
taken there, block by block in double precision, so candidate pairs never become rows: a task gives each query's best
of its buckets. Each query's best of all tables are the result.

Equal vectors are one entry that keeps the ids a result can need: k + 1 of them, the smallest, as ties go to smaller
ids. Buckets over BUCKET_ROWS entries are split by a hash, and the queries that probe them go to each part. Vectors
whose norms differ are hashed with one more coordinate that makes their norms equal, so that nearness by angle is
nearness by inner product (Neyshabur & Srebro, 2015); scores are taken on the original vectors. A query whose probes give
fewer candidates than k is answered from all vectors.

On vectors without structure (isotropic noise) no hashing separates near from far well; the settings are chosen to keep
recall over 0.9 even there, at about the work of one full scan a query. Measured recall is in the README.

Defined results: null or zero vectors and those with null or non-finite components take no part; so do rows with a null
id, and vectors of another length than the most frequent one. Rows with one id are one vector, the smallest. Fewer
candidates than k: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stage

K, TABLES, PROBES, SEED = 20, 16, 12, 20_240_229
BUCKET_ROWS = 20_000
#: Vectors of one matrix product.
BLOCK = 4096
#: Queries answered from all vectors at a time, where their probes gave too few.
RESCUED = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    width = x.shape[1]
    step = 1
    while step < width:
        y = x.reshape(len(x), width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), width)
        step *= 2
    return x / np.sqrt(width)


@dataclass
class CrossPolytope:
    dimension: int
    tables: int = TABLES
    seed: int = SEED

    def __post_init__(self) -> None:
        self.width = 1 << max(self.dimension - 1, 1).bit_length()
        self.signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, 3, self.width))

    def axes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The coordinates along all signed axes: 2 * width of them, plus first."""
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table]:
            y = hadamard(y * signs)
        return np.concatenate([y, -y], 1)

    def buckets(self, x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """The nearest buckets, nearest first."""
        y = self.axes(x, table)
        if probes == 1:
            return y.argmax(1)[:, None]
        probes = min(probes, y.shape[1])
        best = np.argpartition(-y, probes - 1, 1)[:, :probes]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(y, best, 1), 1, kind="stable"), 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v array<double>: one row for each id that takes part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, then smaller id, of one query; the same id counts once."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - 4 * k)[len(score) - 4 * k]
        if (score > least).sum() >= k or least == -np.inf:
            some = score >= least
            score, ids = score[some], ids[some]
    order = np.lexsort((ids, -score))
    score, ids = score[order], ids[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return score[first[:k]], ids[first[:k]]


class Best:
    """Each query's k best entries so far."""

    def __init__(self, k: int):
        self.k = k
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, queries: np.ndarray, query_vectors: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = query_vectors @ vectors.T
        k = min(self.k, len(ids))
        # all that may tie with the k-th are kept; a product's last bits depend on its block, so the kept ones are summed anew
        least = np.partition(scores, len(ids) - k, 1)[:, len(ids) - k]
        least -= 1e-9 * np.maximum(np.abs(least), 1e-9)
        for row, q in enumerate(queries.tolist()):
            some = np.flatnonzero(scores[row] >= least[row])
            s, i = (vectors[some] * query_vectors[row]).sum(1), ids[some]
            if q in self.held:
                s, i = np.concatenate([self.held[q][0], s]), np.concatenate([self.held[q][1], i])
            self.held[q] = best_of(s, i, self.k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.held), 4096):
            part = list(self.held.items())[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in part], pa.int64()), pa.array([i.tolist() for _, (_, i) in part], pa.list_(pa.int64())), pa.array([s.tolist() for _, (s, _) in part], pa.list_(pa.float64()))], names=["query_id", "entries", "scores"])


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, its own id left out.

    queries: a column of ids (query_id) among those of `vectors`; if None, those that are divisible by 20.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, id_col, vector_col), "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    dimension = sizes.n
    rows = rows.where(F.size("v") == dimension)
    # equal vectors become one entry, named by its smallest id, with the k + 1 smallest ids
    numbered = rows.groupBy("v").agg(F.min("vec_id").alias("entry"), F.count("*").alias("n"))
    entries = stage(numbered, "entries")
    copied = entries.where("n > 1").select("v", "entry")
    # the window's row_number() <= k + 1 keeps k + 1 rows of each vector in every map task already
    members = rows.join(copied, "v").withColumn("r", F.row_number().over(Window.partitionBy("entry").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    lists = stage(members.groupBy("entry").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "copies")
    chosen = rows.where(F.col("vec_id") % 20 == 0) if queries is None else rows.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = chosen.select(F.col("vec_id").alias("query_id"), "v")
    norms = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("most"), F.min(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("least"), F.count("*").alias("n")).first()
    equal = norms.least > 0.999 * norms.most
    most, hashing = norms.most, CrossPolytope(dimension + (not equal), tables)

    def padded(x: np.ndarray, entry: bool) -> np.ndarray:
        if equal:
            return x
        rest = np.sqrt(np.maximum(most**2 - (x * x).sum(1), 0)) if entry else np.zeros(len(x))
        return np.concatenate([x, rest[:, None]], 1)

    def place(entry: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    x = matrix(batch.column("v"), dimension)
                    raw = pa.array([r.tobytes() for r in x], pa.binary())
                    y = padded(x, entry)
                    for t in range(tables):
                        b = hashing.buckets(y, t, 1 if entry else probes)
                        for p in range(b.shape[1]):
                            yield pa.RecordBatch.from_arrays([pa.array(t * 2 * hashing.width + b[:, p]), batch.column("id"), raw], names=["bucket", "id", "v"])

        return run

    schema = "bucket long, id long, v binary"
    held = stage(entries.select(F.col("entry").alias("id"), "v").mapInArrow(place(True), schema), "buckets")
    # at most tables * 2 * width counts
    counts = {r.bucket: r["count"] for r in held.groupBy("bucket").count().collect()}
    parts = {b: -(-n // BUCKET_ROWS) for b, n in counts.items()}
    large = {b: n for b, n in parts.items() if n > 1}
    split = F.create_map(*(F.lit(x) for pair in large.items() for x in pair)) if large else None
    n_parts = F.coalesce(split[F.col("bucket")], F.lit(1)) if large else F.lit(1)
    entry_rows = held.select("bucket", F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "v")
    probe_rows = asked.select(F.col("query_id").alias("id"), "v").mapInArrow(place(False), schema)
    probe_rows = probe_rows.select("bucket", F.explode(F.sequence(F.lit(0), n_parts.cast("int") - 1)).alias("part"), F.lit(0).alias("kind"), "id", "v")
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = probe_rows.unionByName(entry_rows).repartition(n_tasks, "bucket", "part").sortWithinPartitions("bucket", "part", "kind", "id")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets come one after another, the queries of each before its entries."""
        best = Best(k + 1)
        key, ids, vectors = None, [], []

        for batch in batches:
            bucket, part, kind = (batch.column(c).to_numpy() for c in ("bucket", "part", "kind"))
            id_, raw = batch.column("id").to_numpy(), batch.column("v")
            edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)], strict=True):
                now = (bucket[a], part[a])
                x = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), np.float64).reshape(b - a, dimension)
                if now != key:
                    key, ids, vectors = now, [], []
                if kind[a] == 0:
                    ids.append(id_[a:b])
                    vectors.append(x)
                elif ids:
                    if len(ids) > 1:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    for q in range(0, len(ids[0]), 1024):
                        for e in range(0, b - a, BLOCK):
                            best.add(ids[0][q : q + 1024], vectors[0][q : q + 1024], id_[a + e : min(b, a + e + BLOCK)], x[e : e + BLOCK])
            if len(best.held) > 100_000:
                yield from best.batches()
                best.held.clear()
        yield from best.batches()

    found = met.mapInArrow(search, "query_id long, entries array<long>, scores array<double>")
    # one packed row for each query and task; its pairs meet in one group a query, at most tables * probes * (k + 1) of them
    merged = stage(merge(found, k + 1), "found")
    total = rows.count()
    need = min(k, total - 1)
    ready = expand(merged, lists, k)
    few = asked.join(ready.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < need).select("query_id", "v")
    few = stage(few, "few")
    left, out = few.count(), ready
    if left and need:
        rescued = None
        share = -(-left // RESCUED)
        for turn in range(share):
            some = few.where(F.pmod(F.xxhash64("query_id"), F.lit(share)) == turn).collect()
            got = expand(merge(scan(entries, some, dimension, k + 1), k + 1), lists, k)
            rescued = got if rescued is None else rescued.unionByName(got)
        out = ready.join(few.select("query_id"), "query_id", "left_anti").unionByName(stage(rescued, "rescued"))
    return out


def merge(found: DataFrame, k: int) -> DataFrame:
    """query_id, best array<struct<score, entry>>: the k best distinct entries, nearest first."""
    pairs = F.array_distinct(F.flatten(F.collect_list(F.zip_with("scores", "entries", lambda s, e: F.struct((-s).alias("far"), e.alias("entry"))))))
    return found.groupBy("query_id").agg(F.slice(F.sort_array(pairs), 1, k).alias("best"))


def expand(merged: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """Entries become their vectors' ids; a query's own id goes, and k stay."""
    flat = merged.select("query_id", F.explode("best").alias("b")).select("query_id", F.col("b.far").alias("far"), F.col("b.entry").alias("entry"))
    ids = flat.join(lists, "entry", "left").select("query_id", "far", F.explode(F.coalesce("ids", F.array("entry"))).alias("vec_id")).where("vec_id <> query_id")
    ranked = ids.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "vec_id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))


def scan(entries: DataFrame, some: list, dimension: int, k: int) -> DataFrame:
    """A bounded block of queries against all entries."""
    ids = np.array([r.query_id for r in some], np.int64)
    asked = np.array([r.v for r in some], np.float64).reshape(len(ids), dimension)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                for q in range(0, len(ids), 512):
                    best.add(ids[q : q + 512], asked[q : q + 512], part.column("id").to_numpy(), matrix(part.column("v"), dimension))
        yield from best.batches()

    return entries.select(F.col("entry").alias("id"), "v").mapInArrow(run, "query_id long, entries array<long>, scores array<double>")
