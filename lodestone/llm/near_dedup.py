"""Operator 3, near-duplicate groups by ProbMinHash, banding and verification.

Documents are weighted sets of word shingles; their similarity is the probability Jaccard of the weights (Moulton &
Jiang, 2018), which for equal weights is the Jaccard similarity. ProbMinHash (Ertl, 2022) estimates it: every shingle
is a Poisson process of arrivals, its rate the shingle's weight, and each arrival falls on a random register; a register
keeps the shingle that came first. Arrivals of one shingle are the same in every document, so the share of equal
registers estimates the similarity. A shingle stops once its next arrival is later than all registers' first ones.

Texts of the same words are one node. A node's registers, sixteen bits each, are cut into BANDS keys of ROWS; nodes that
share a key are candidates. They are compared in turns, and never all with all while a cheaper turn may still join them:

1. each node of a key with the key's first node;
2. in CHAINS turns, neighbours in a random order of the key's nodes, if they aren't in one group yet; large keys are
   split at random for that;
3. the nodes of a key that are in different groups by now meet with their words, and every pair that is not in one group
   is compared where it shares its first band, the likeliest first. The task keeps the groups as it finds them and gives
   only the links that join two, fewer than nodes, so pairs never become rows. Keys of more than BLOCK words are cut into
   blocks, and each two blocks meet in a cell of their own, but for two of the key's largest group.

Links are verified on the exact similarity of the shingles, so groups have no false one, and every pair that shares a band
is verified or already joined: two texts at the threshold are missed only with the chance of no common band,
(1 - SIMILARITY ** ROWS) ** BANDS, about 2 in 100 000, whatever the size of their keys. Groups are connected
components of verified links, found by contraction with joins; nothing is gathered by the driver.

Defined results: null and empty texts, and those of blanks alone, have no words and are copies of one another. A text
shorter than a shingle is one shingle. Every row gets its class, rows of one id too; a class is named by its smallest
id (null if it has none), and the row kept is one of that id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lodestone.llm.common import Scope, col, reread, small_batches, stage, stage_path
from lodestone.llm.part_files import filter_rows, write_rows

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
CHAINS, CHAIN_ROWS = 2, 4096
#: Words (and a node's registers, as words) of a block of a key's nodes, about.
BLOCK, REGISTER_WORDS = 1 << 19, REGISTERS // 4
#: Partners that look nearest, with which a node is compared before the others.
NEAREST = 6
#: Texts to compare meet in tiles of about so many heads and blocks of so many members.
HEADS, MEMBERS = 64, 512
#: Rows, and words of several rows, that a worker cuts into shingles at once.
SLICE_ROWS, SLICE_WORDS = 512, 1 << 18

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def split_words(text: Column) -> Column:
    """The words, parted by white space, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def shingles(words: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in a row: document number, shingle and weight, sorted by both.

    words: the documents' word hashes in a row; counts: how many each has. A document of fewer words than a shingle has one, of all its words.
    """
    n_docs = len(counts)
    doc = np.repeat(np.arange(n_docs), np.maximum(counts - width + 1, np.minimum(counts, 1)))
    ends = np.cumsum(counts)
    starts = ends - counts
    first = np.cumsum(np.maximum(counts - width + 1, np.minimum(counts, 1))) - np.maximum(counts - width + 1, np.minimum(counts, 1))
    at = starts[doc] + np.arange(len(doc)) - first[doc]
    w = mix(words.view(np.uint64))
    out = np.zeros(len(doc), np.uint64)
    for k in range(width):
        inside = at + k < ends[doc]
        out = out * _U(0x9E3779B97F4A7C15) + np.where(inside, w[np.minimum(at + k, max(len(w) - 1, 0))], _U(1)) if len(w) else out
    out = mix(out)
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.append(True, (np.diff(doc) != 0) | (np.diff(out) != 0)) if len(doc) else np.zeros(0, bool)
    where = np.flatnonzero(new)
    return doc[where], out[where], np.diff(np.append(where, len(doc))).astype(np.float64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE_ROWS rows and SLICE_WORDS words (column words); a row of more words is a slice by itself."""
    ends = np.cumsum(np.array(batch.column("words").value_lengths(), np.int64))
    at = 0
    while at < batch.num_rows:
        words = int(ends[at - 1]) if at else 0
        to = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(ends, words + SLICE_WORDS, "right"))))
        yield batch.slice(at, to - at)
        at = to


def arrivals(element: np.ndarray, weight: np.ndarray, before: np.ndarray, index: int, n: int, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """The next n arrivals of each element, from number `index` on, after time `before`: their times and registers."""
    bits = mix(element[:, None] + mix(np.arange(index, index + n, dtype=np.uint64) * _U(0xD1342543DE82EF95) + _U(1))[None, :])
    wait = -np.log(((bits >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52)
    time = before[:, None] + np.cumsum(wait, 1) / weight[:, None]
    register = (mix(bits ^ _U(0xA0761D6478BD642F)) >> _U(33)).astype(np.int64) % registers
    return time, register


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The element that came first at each register; documents in rows. Documents without elements have zeros."""
    sizes = np.bincount(doc, minlength=n_docs)
    first = np.full((n_docs, registers), np.inf)
    held = np.zeros((n_docs, registers), np.uint64)
    flat_first, flat_held = first.ravel(), held.ravel()
    # documents of few elements need more arrivals of each: so many at once that two or three turns are enough
    needed = registers * (np.log(registers) + 0.6)
    step = np.maximum(1, 2 ** np.ceil(np.log2(0.6 * needed / np.maximum(sizes, 1)))).astype(np.int64)
    for n in np.unique(step[sizes > 0]).tolist():
        live = np.flatnonzero(step[doc] == n)
        before, index = np.zeros(len(live)), 0
        while len(live):
            chunk = max(1, (1 << 19) // n)
            ends = np.empty(len(live))
            for a in range(0, len(live), chunk):
                part = live[a : a + chunk]
                time, register = arrivals(element[part], weight[part], before[a : a + chunk], index, n, registers)
                ends[a : a + chunk] = time[:, -1]
                cell = (doc[part][:, None] * registers + register).ravel()
                time = time.ravel()
                early = np.flatnonzero(time < flat_first[cell])
                cell, time, who = cell[early], time[early], np.repeat(element[part], n)[early]
                np.minimum.at(flat_first, cell, time)
                won = time == flat_first[cell]
                flat_held[cell[won]] = who[won]
            last = first.max(1)
            on = ends < last[doc[live]]
            live, before, index = live[on], ends[on], index + n
    return held


def signed(words: DataFrame, registers: int = REGISTERS, width: int = SHINGLE) -> DataFrame:
    """words: any columns and `words`, hashes of each text's words. The same with `size`, their number, and `registers` (16 bits each) instead."""
    fields = [f for f in words.schema.fields if f.name != "words"]
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                lists = batch.column("words")
                counts = np.array(lists.value_lengths(), np.int64)
                doc, element, weight = shingles(lists.flatten().to_numpy(zero_copy_only=False), counts, width)
                held = (mix(signatures(doc, element, weight, len(counts), registers)) >> _U(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(counts), pa.array([r.tobytes() for r in held], pa.binary())], names=[*names, "size", "registers"])

    return words.mapInArrow(run, StructType([*fields, StructField("size", LongType()), StructField("registers", BinaryType())]))


def band(registers: Column, number: Column) -> Column:
    """The key of one band."""
    return F.xxhash64(number, F.substring(registers, number * (2 * ROWS) + 1, F.lit(2 * ROWS)))


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact similarity of weighted sets: sorted distinct elements a, b and their weights x, y."""
    every = np.union1d(a, b)
    p, q = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, a)] = x
    q[np.searchsorted(every, b)] = y
    with np.errstate(divide="ignore"):
        ratio = p / q
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    # sum over d' of max(p[d'] / p[d], q[d'] / q[d]): the first wins where the ratio is at least d's
    at = np.searchsorted(ratio, ratio, "left")
    high = np.append(np.cumsum(p[::-1])[::-1], 0)[at]
    low = np.append(0, np.cumsum(q))[at]
    both = (p > 0) & (q > 0)
    return float((1 / (high[both] / p[both] + low[both] / q[both])).sum())


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, partitions: int, width: int) -> DataFrame:
    """a, b of `pairs` (distinct) whose texts are similar. texts: row, words.

    About HEADS nodes a make a tile; a text b comes to a tile once, with the list of the tile's nodes that it is to be
    compared with, and in blocks of about MEMBERS, to which the tile's heads are copied.
    """
    pairs = stage(pairs, "pairs")
    heads = pairs.select("a").distinct()
    tiles = max(1, -(-heads.count() // HEADS))
    tile = F.pmod(F.xxhash64("a"), F.lit(tiles))
    texts = only(texts, pairs.select(F.explode(F.array("a", "b")).alias("node"))).withColumnRenamed("row", "node")
    wanted = pairs.groupBy(tile.alias("tile"), "b").agg(F.collect_list("a").alias("heads"))
    counts = wanted.groupBy("tile").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    members = wanted.join(counts, "tile").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")).join(texts.withColumnRenamed("node", "b"), "b").select("tile", "block", "b", "heads", "words")
    copied = heads.withColumn("tile", tile).join(counts, "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "a").join(texts.withColumnRenamed("node", "a"), "a")
    met = copied.select("tile", "block", F.col("a").alias("b"), F.lit(None).cast("array<long>").alias("heads"), "words").unionByName(members).repartition(partitions, "tile", "block").sortWithinPartitions("tile", "block", F.col("heads").isNotNull(), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        now = None
        for whole in batches:
            for batch in slices(whole):
                lists = batch.column("words")
                counts = np.array(lists.value_lengths(), np.int64)
                doc, element, weight = shingles(lists.flatten().to_numpy(zero_copy_only=False), counts, width)
                edges = np.searchsorted(doc, np.arange(len(counts) + 1))
                out: list[tuple[int, int]] = []
                for k, (t, block, b, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("tile", "block", "b", "heads")), strict=True)):
                    own = element[edges[k] : edges[k + 1]], weight[edges[k] : edges[k + 1]]
                    if (t, block) != now:
                        now, known = (t, block), {}
                    if asked is None:
                        known[b] = own
                    else:
                        out += [(a, b) for a in asked if probability_jaccard(*known[a], *own) >= threshold - 1e-12]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def mapped(df: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """A column replaced by what `to` (node, label) has for it, if anything."""
    return df.join(to.select(F.col("node").alias(column), F.col("label").alias("__to")), column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")


def contract(edges: DataFrame) -> DataFrame:
    """node, label: every node of the edges (a, b) that isn't the smallest of its component, and that smallest; staged."""
    with Scope(edges.sparkSession) as scope:
        left = stage(edges.where("a <> b").distinct(), "edges")
        labels = None
        while not left.isEmpty():
            ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = stage(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).where("label < node"), "step")
            labels = stage(step if labels is None else mapped(labels, "label", step).unionByName(step.join(labels.select("node"), "node", "left_anti")), "labels")
            left = stage(mapped(mapped(left, "a", step), "b", step).where("a <> b").distinct(), "edges")
        if labels is None:
            labels = stage(left.select(F.col("a").alias("node"), F.col("b").alias("label")), "labels")
        scope.keep(labels)
    return labels


def joined(labels: DataFrame | None, edges: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The labels after more edges between nodes; staged. What finding the edges stages goes with them."""
    with Scope(spark) as scope:
        links = stage(edges(), "links")
        if labels is None:
            out = contract(links)
        else:
            more = contract(mapped(mapped(links, "a", labels), "b", labels))
            out = stage(mapped(labels, "label", more).unionByName(more.join(labels.select("node"), "node", "left_anti")), "labels")
        scope.keep(out)
    return out


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, carry: tuple[str, ...] = (), width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, class_id, kept) for every row, and the staged rows themselves: row, doc_id, text, and the carried columns as carried_0, carried_1, ..."""
    spark = docs.sparkSession
    with Scope(spark) as scope:
        rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"), *(col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
        rows = stage(rows, "documents")
        words = split_words(F.col("text"))
        # whole texts and all their words go to Python workers in small batches, in a session of their own
        narrow = small_batches(spark)
        seen = reread(rows, narrow).select("row", "doc_id", F.unhex(F.substring(F.sha2(F.array_join(words, " "), 256), 1, 32)).alias("same"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
        copies = reread(stage(signed(seen, width=width), "signed"), spark)
        # one node for each sequence of words, named by its first row; copies are counted before the shuffle
        nodes = stage(copies.groupBy("same").agg(F.min("row").alias("node"), F.min("doc_id").alias("low"), F.first("registers").alias("registers"), F.first("size").alias("size")), "nodes")
        labels = labelled(rows, nodes, threshold, width)
        named = mapped(nodes.select("same", "node", "low", F.col("node").alias("label")), "label", labels)
        named = stage(named, "named")
        classes = named.groupBy("label").agg(F.min("low").alias("class_id"))
        of_text = named.join(classes, "label").select("same", "label", "class_id")
        out = stage(copies.select("row", "doc_id", "same").join(of_text, "same").select("row", "doc_id", "label", "class_id"), "classed")
        scope.keep(rows, out)
    first = out.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("row").alias("row"))
    return out.join(first.select("row", F.lit(True).alias("kept")), "row", "left").select("row", "doc_id", "class_id", F.coalesce("kept", F.lit(False)).alias("kept")), rows


def labelled(rows: DataFrame, nodes: DataFrame, threshold: float, width: int) -> DataFrame:
    """node, label of the nodes that are not the smallest of their group."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with Scope(spark) as scope:
        signs = nodes.where(F.col("size") > 0).select("node", "size", "registers")
        keys = signs.select("node", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: band(F.col("registers"), k))).alias("band", "key"))
        shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
        met = stage(keys.join(shared, "key"), "candidates")
        found = only(reread(rows, small_batches(spark)).select("row", "text"), met.select("node"))
        texts = reread(stage(found.select("row", F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w)).alias("words")), "candidate-texts"), spark)

        def compared(pairs: DataFrame) -> DataFrame:
            return verified(pairs, texts, threshold, partitions, width)

        # 1. with the first of each key
        labels = joined(None, lambda: compared(met.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()), spark)
        # 2. with neighbours in a random order; a key of two nodes, and the first of each key, have met all by now
        met = met.where("n > 2")
        for turn in range(CHAINS):
            now = mapped(met.select("key", "n", "node", F.col("node").alias("label")), "label", labels)
            order = Window.partitionBy("key", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / CHAIN_ROWS))).orderBy(F.xxhash64("node", F.lit(-1 - turn)), "node")
            near = now.withColumns({"a": F.lag("node").over(order), "other": F.lag("label").over(order)}).where("other <> label")
            pairs = near.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
            labels = joined(labels, lambda p=pairs: compared(p), spark)
        # 3. all that are still apart
        now = mapped(met.where("node <> first").select("key", "band", "node", "size", F.col("node").alias("label")), "label", labels)

        def meet() -> DataFrame:
            apart = stage(cells(now), "cells")
            moved = only(texts, apart.select("node")).select(F.col("row").alias("node"), "words").join(signs.select("node", "registers"), "node")
            ready = apart.join(moved, "node").repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
            return ready.select("key", "band", "i", "j", "second", "node", "label", "registers", "words").mapInArrow(lambda b: still_apart(b, threshold, width), "a long, b long")

        labels = joined(labels, meet, spark)
        scope.keep(labels)
    return labels


def only(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of a staged table (column row) that are among `nodes` (a column node, repeats allowed); the table is not shuffled."""
    spark = table.sparkSession
    folder = stage_path(spark, "row-names")
    write_rows(nodes.select(F.col("node").alias("row")).distinct(), folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return filter_rows(table, folder, keep=True)


def cells(now: DataFrame) -> DataFrame:
    """key, band, node, label and the cell (i, j) of the blocks i and j of the key; second: the node is of block j, not i.

    A key's largest group is cut into blocks of its own, which meet the other blocks but not one another.
    """
    weight = F.col("size") + REGISTER_WORDS
    by_label = now.groupBy("key", "label").agg(F.sum(weight).alias("words"))
    most = F.max(F.struct("words", "label"))
    by_key = by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("words").alias("words"), most.alias("most")).where("labels > 1")
    split = F.col("words") > BLOCK
    by_key = by_key.select(
        "key", F.when(split, F.col("most.label")).alias("main"), F.when(split, F.ceil((F.col("words") - F.col("most.words")) / BLOCK)).otherwise(1).cast("int").alias("others"),
        F.when(split, F.ceil(F.col("most.words") / BLOCK)).otherwise(0).cast("int").alias("mains"))
    own = F.col("label").eqNullSafe(F.col("main"))
    block = F.when(own, F.col("others") + F.pmod(F.xxhash64("node"), F.greatest("mains", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    partners = F.sequence(F.lit(0), F.when(own, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    placed = now.join(by_key, "key").withColumn("block", block).withColumn("with", F.explode(partners))
    return placed.select("key", "band", "node", "label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).alias("second"))


class Groups:
    """Groups of a cell's nodes, by position, joined as links are found."""

    def __init__(self, labels: np.ndarray):
        self.of = np.unique(labels, return_inverse=True)[1]

    def join(self, a: int, b: int) -> None:
        self.of[self.of == self.of[b]] = self.of[a]


class Shingled:
    """The shingles of a cell's nodes, by position."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, width: int):
        doc, self.element, self.weight = shingles(words, counts, width)
        self.edge = np.searchsorted(doc, np.arange(len(counts) + 1))
        self.total = np.bincount(doc, self.weight, len(counts))
        distinct, self.number = np.unique(self.element, return_inverse=True)
        self.dense = np.zeros(len(distinct))

    def similarity(self, a: int, b: int) -> float:
        x, y = (slice(self.edge[k], self.edge[k + 1]) for k in (a, b))
        return probability_jaccard(self.element[x], self.weight[x], self.element[y], self.weight[y])

    def at_most(self, a: int, others: np.ndarray) -> np.ndarray:
        """What the similarity of a with each of the others can't exceed; exact where common shingles' weights are in one proportion.

        The similarity sums 1 / sum over all d' of max(x[d'] / x[d], y[d'] / y[d]) over common d. Of that maximum, elements of one set alone give
        their own term, and common ones at least the greater of both sums.
        """
        size = self.edge[others + 1] - self.edge[others]
        which = np.repeat(np.arange(len(others)), size)
        at = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + self.edge[others][which]
        own = slice(self.edge[a], self.edge[a + 1])
        self.dense[self.number[own]] = self.weight[own]
        x = self.dense[self.number[at]]
        self.dense[self.number[own]] = 0
        both = np.flatnonzero(x)
        x, y, which = x[both], self.weight[at[both]], which[both]
        n = len(others)
        total, totals = self.total[a], self.total[others]
        only_x, only_y = total - np.bincount(which, x, n), totals - np.bincount(which, y, n)
        least = np.maximum(total / x + only_y[which] / y, only_x[which] / x + totals[which] / y)
        return np.bincount(which, 1 / least, n)


def still_apart(batches: Iterable[pa.RecordBatch], threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    """Links a, b that join groups, of the nodes of one cell after another. Rows come sorted by cell."""
    enough = threshold - 1e-12

    def compare(rows: pa.Table) -> pa.RecordBatch:
        node, label, second = (rows.column(c).to_numpy() for c in ("node", "label", "second"))
        lists = rows.column("words").combine_chunks()
        held = Shingled(lists.flatten().to_numpy(zero_copy_only=False), np.array(lists.value_lengths(), np.int64), width)
        registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), "<u2").reshape(len(node), REGISTERS)
        keys = np.zeros((len(node), BANDS), np.uint64)
        for k in range(ROWS):
            keys = mix(keys * _U(0x9E3779B97F4A7C15) + registers[:, k::ROWS] + _U(1))
        mine = int(rows.column("band")[0].as_py())
        apart, links = Groups(label), []
        # small groups first: the largest one's nodes are compared with by others only
        _, group, sizes = np.unique(label, return_inverse=True, return_counts=True)
        order = np.lexsort((node, label, sizes[group]))
        if second.any():
            firsts, seconds = order[~second[order]], order[second[order]]
        else:
            firsts = seconds = order
        for turn, a in enumerate(firsts.tolist()):
            left = seconds if second.any() else seconds[turn + 1 :]
            left = left[apart.of[left] != apart.of[a]]
            left = left[(keys[left] == keys[a]).argmax(1) == mine]
            if not len(left):
                continue
            like = (registers[left] == registers[a]).sum(1)
            left = left[np.argsort(-like, kind="stable")]
            for part, sure in ((left[:NEAREST], False), (left[NEAREST:], True)):
                part = part[apart.of[part] != apart.of[a]]
                if sure and len(part):
                    most = held.at_most(a, part)
                    part = part[most >= enough - 1e-9]
                for b in part.tolist():
                    if apart.of[b] != apart.of[a] and held.similarity(a, b) >= enough:
                        links.append((node[a], node[b]))
                        apart.join(a, b)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    now, parts = None, []
    for batch in batches:
        cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")])
        edges = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if parts and tuple(cell[:, a]) != now:
                yield compare(pa.Table.from_batches(parts))
                parts = []
            now = tuple(cell[:, a])
            parts.append(batch.slice(a, b - a))
    if parts:
        yield compare(pa.Table.from_batches(parts))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """`docs` without all but one of each class; no text is shuffled."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    classed, rows = groups(docs, id_col, text_col, threshold, others)
    folder = stage_path(docs.sparkSession, "dropped-rows")
    write_rows(classed.where(~F.col("kept")).select("row"), folder, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = filter_rows(rows, folder, keep=False)
    named = {id_col: F.col("doc_id"), text_col: F.col("text")} | {c: F.col(f"carried_{k}") for k, c in enumerate(others)}
    return kept.select(*(named[c].alias(c) for c in docs.columns))
