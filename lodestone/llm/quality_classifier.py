"""Operator 1, quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or abstain on every document. The counts of their vote patterns over
the whole corpus (at most 3 ** 8 of them, whatever the corpus) are what expectation-maximisation needs to estimate
each labeller's accuracy and the share of good documents (Dawid & Skene, 1979; Ratner et al., 2016). The posterior of
a document's pattern is its soft label, and these labels fit a logistic scorer on hashed word-shape features.

Defined results: a null or empty text has no words, every labeller abstains, and the scorer gives its
bias; it gets a row like any other. Repeated rows are scored each by itself. A null id is passed through, and trains like any other. An empty
table gives an empty result. Other columns of the input are carried if asked for, and never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import col, hash_share, stage

#: Votes, in base 3 within a pattern.
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "separators", "repeats", "sentences", "lines", "longest", "variety", "shouting")
DIMENSIONS = 1 << 16
#: About so many documents at most, and of so many bytes of text together, chosen row by row by a hash, fit the scorer. Counts for the weak-label model use all.
TRAINING_DOCUMENTS, TRAINING_BYTES = 6000, 64_000_000
#: Words of the windows, over the whole text, of which the poorest shows its variety.
WINDOW = 400

_SYMBOLS = re.compile(r"[#*$%&|<>{}=\\^~]")
_SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "Z"), (re.compile(r"(?:(?!Z)[^\W\d_])+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1\1"))


def votes(text: str) -> int:
    """The labellers' votes on one text, as one number in base 3."""
    words = text.split()
    n = len(words)
    if not n:
        return 0
    symbols = len(_SYMBOLS.findall(text)) / n
    bars = sum(1 for w in words if not w[-1].isalnum() and not any(map(str.isalnum, w))) / n
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    ends = sum(1 for w in words if w[-1] in ".!?") / n
    lines = [x for x in text.split("\n") if x.strip()]
    doubled = 1 - len(set(lines)) / max(len(lines), 1)
    longest = max(map(len, words))
    shouting = sum(1 for w in words if len(w) > 1 and w.isupper()) / n
    variety = min(len(set(words[a : a + WINDOW])) / min(n, WINDOW) for a in {*range(0, n - WINDOW + 1, WINDOW), max(0, n - WINDOW)})

    def judge(value: float, good: float, bad: float) -> int:
        """GOOD up to `good`, BAD over `bad`, ABSTAIN between."""
        return GOOD if value <= good else BAD if value > bad else ABSTAIN

    given = (
        judge(symbols, 0.03, 0.2),
        judge(bars, 0.02, 0.12),
        judge(repeats, 0.05, 0.15) if n >= 10 else ABSTAIN,
        judge(-ends, -0.02, 0) if 40 <= n and ends < 0.4 else ABSTAIN,
        judge(doubled, 0.1, 0.5) if len(lines) > 4 else ABSTAIN,
        judge(longest, 40, 200),
        judge(-variety, -0.35, -0.12) if n >= 60 else ABSTAIN,
        judge(shouting, 0.1, 0.4) if n >= 10 else ABSTAIN,
    )
    return sum(v * 3**j for j, v in enumerate(given))


@dataclass
class WeakLabelModel:
    """chance[j, y]: that labeller j, if it votes, votes good where the truth is y (0 bad, 1 good); good: their share."""

    chance: np.ndarray
    good: float

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """The chance of good, for patterns of votes. Who abstains says nothing: a text may be too short to judge."""
        digits = pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
        odds = np.full(len(pattern), np.log(self.good / (1 - self.good)))
        for j, (bad, good) in enumerate(self.chance):
            odds += np.array([0.0, np.log((1 - good) / (1 - bad)), np.log(good / bad)])[digits[:, j]]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracy(self) -> np.ndarray:
        """For each labeller, the chance that its vote is right."""
        return (1 - self.chance[:, 0]) * (1 - self.good) + self.chance[:, 1] * self.good


#: Bounds of the labellers' chances. Faults exclude one another, so most labellers miss most bad documents, yet a vote
#: against a document is seldom wrong. Without them the estimate takes one frequent kind of fault for the whole class.
MOST_MISSED, MOST_FALSE_ALARMS = 0.8, 0.005


def fit_labels(pattern: np.ndarray, count: np.ndarray, rounds: int = 300) -> WeakLabelModel:
    """Expectation-maximisation over the patterns' counts, with bounded chances (the maximum within the bounds is at them)."""
    k = len(LABELLERS)
    model = WeakLabelModel(np.tile([0.7, 0.999], (k, 1)), 0.85)
    digits = pattern[:, None] // 3 ** np.arange(k) % 3
    voted, up = digits != ABSTAIN, digits == GOOD
    for _ in range(rounds):
        p = model.posterior(pattern)
        weights = np.stack([count * (1 - p), count * p])
        new = ((weights @ up + np.array([[0.7], [0.999]])) / (weights @ voted + 1)).T
        new = np.clip(new, [0.02, 1 - MOST_FALSE_ALARMS], [MOST_MISSED, 1 - 1e-6])
        good = float(np.clip(weights[1].sum() / max(weights.sum(), 1e-9), 0.02, 0.98))
        moved = np.abs(new - model.chance).max()
        model = WeakLabelModel(new, good)
        if moved < 1e-7:
            break
    return model


class Shapes(dict):
    """Word to the number of its shape: capitals, letters, digits and runs of one mark are each told by one sign. Bounded."""

    def __missing__(self, word: str) -> int:
        shape = word
        for pattern, sign in _SHAPES:
            shape = pattern.sub(sign, shape)
        if len(self) > 200_000:
            self.clear()
        self[word] = out = zlib.crc32(shape[:24].encode())
        return out


def features(text: str, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shape words and pairs of neighbours, with a sign for a word that repeats the one before; weights have length 1."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.fromiter(map(shapes.__getitem__, words), np.uint64, len(words))
    same = np.fromiter(map(str.__eq__, words[1:], words), bool, len(words) - 1)
    pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(23)
    pairs[same] = np.uint64(7)
    slots, n = np.unique(np.concatenate([ids, pairs]) % np.uint64(DIMENSIONS), return_counts=True)
    weight = np.log1p(n)
    return slots.astype(np.int64), weight / np.sqrt(weight @ weight)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, steps: int = 300, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels, by accelerated gradient steps; the last weight is the bias."""
    w = np.zeros(DIMENSIONS + 1, np.float64)
    if not rows:
        return w.astype(np.float32)
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slot, value = np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows])
    ahead, before = w.copy(), w.copy()
    for t in range(steps):
        z = np.bincount(row, ahead[slot] * value, len(rows)) + ahead[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        step = np.append(np.bincount(slot, off[row] * value, DIMENSIONS), off.sum()) / len(rows) + decay * ahead
        w = ahead - 2.0 * step
        ahead, before = w + t / (t + 3) * (w - before), w
    return w.astype(np.float32)


def score(text: str, weights: np.ndarray, shapes: Shapes) -> float:
    slot, value = features(text, shapes)
    return float(1 / (1 + np.exp(-np.clip(weights[slot] @ value + weights[-1], -30, 30))))


def small(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@dataclass
class QualityModel:
    labels: WeakLabelModel
    weights: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_documents: int = TRAINING_DOCUMENTS) -> QualityModel:
    """Both models, from one pass over all documents. What reaches the driver is bounded: patterns, and the sample's features."""
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(col(text_col))), F.lit(0)).alias("bytes")).first()
    share = min(training_documents / max(total.n, 1), TRAINING_BYTES / max(total.bytes, 1))
    # by row: rows of one id, or without any, are chosen each by itself
    rows = docs.select(F.coalesce(col(text_col), F.lit("")).alias("text"), hash_share(F.struct(col(id_col).alias("id"), F.monotonically_increasing_id().alias("row")), share).alias("sampled"))

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        counts: dict[int, int] = {}
        for batch in small(batches):
            pattern, slots, values = [], [], []
            for text, sampled in zip(batch.column("text").to_pylist(), batch.column("sampled").to_pylist(), strict=True):
                p = votes(text)
                counts[p] = counts.get(p, 0) + 1
                if sampled:
                    slot, value = features(text, shapes)
                    pattern.append(p)
                    slots.append(slot.astype("<i4").tobytes())
                    values.append(value.astype("<f4").tobytes())
            if pattern:
                yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array([0] * len(pattern), pa.int64()), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], names=["pattern", "n", "slots", "weights"])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.nulls(len(counts), pa.binary()), pa.nulls(len(counts), pa.binary())], names=["pattern", "n", "slots", "weights"])

    seen = stage(rows.mapInArrow(label, "pattern long, n long, slots binary, weights binary"), "labelled")
    counts = seen.where("n > 0").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    labels = fit_labels(np.array([r.pattern for r in counts], np.int64), np.array([r.n for r in counts], float))
    sample = sorted((bytes(r.slots), bytes(r.weights), r.pattern) for r in seen.where("slots is not null").collect())
    known = labels.posterior(np.array([p for *_, p in sample], np.int64)) if sample else np.zeros(0)
    return QualityModel(labels, fit_scorer([(np.frombuffer(s, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for s, v, _ in sample], known))


def apply(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5, score_col: str = "quality_score", keep_col: str = "quality_kept") -> DataFrame:
    """`docs` with the scorer's estimate that a document is good, and whether it reaches `threshold`. All columns stay, but for those of the two names, which are replaced; no shuffle."""
    weights = model.weights
    text = col(text_col).alias("__text")
    fields = [f for f in docs.schema.fields if f.name.lower() not in (score_col.lower(), keep_col.lower())]
    # inside, columns go by number: names may hold dots
    names = [f"c{k}" for k in range(len(fields))]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, fields, strict=True)), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in small(batches):
            p = [score(text or "", weights, shapes) for text in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p, pa.float64()), pa.array([x >= threshold for x in p], pa.bool_())], names=[*names, "score", "keep"])

    judged = docs.select(*(col(f.name).alias(n) for n, f in zip(names, fields, strict=True)), text).mapInArrow(run, schema)
    return judged.select(*(F.col(n).alias(f.name) for n, f in zip(names, fields, strict=True)), F.col("score").alias(score_col), F.col("keep").alias(keep_col))
