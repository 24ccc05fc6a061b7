"""Operator 5, packing: minimum bin slack over the multiset of remaining lengths.

A document's ids are cut into full windows and one remainder. Full windows are sequences already. The remainders of a
task are a multiset of lengths below the window, and each window is filled by minimum bin slack (Gupta & Ho, 1999): the
longest remainder is taken, a bitset dynamic program over the counts of the others finds the reachable fill closest to
capacity, and walking the stored bitsets back gives how many of each length make it. The same pattern is used as often
as the counts allow. If no subset fills a window, the shortest remaining piece that closes the gap is cut. What is left
at the end of a task, less than one window, is cut at powers of two, which need no padding.

Every task packs its own documents: no shuffle, memory bounded by one group of documents, and less than one window a
task isn't full. Sequence ids are unique, not consecutive: the task's number stands in the high bits. A task that runs
anew gives the same rows as long as it reads the same rows, as a file scan does.

Defined results: a null or empty text has the end id alone. Repeated rows and null ids are packed each by itself; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import id_text
from lodestone.llm.tokens import library_encoder

WINDOW, END_ID = 1024, 0
#: A task packs its documents in groups of about so many ids, so that it holds no more of them at once.
GROUP_IDS = 8_000_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the fullest window. lengths: descending, with counts over 0.

    The longest is always taken. Bit b of a row's bitset: the rows so far can make b. A count is split into powers of
    two, so each row is a shift; the walk back takes a row where the fill wasn't reachable without it.
    """
    first = lengths[0]
    target = capacity - first
    full = 1 << target
    mask = (full << 1) - 1
    reach, rows = 1, []
    for length in lengths:
        left = min(counts[length] - (length == first), target // length)
        times = 1
        while left > 0:
            times = min(times, left)
            rows.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    used = {first: 1}
    for length, times, before in reversed(rows):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + times
            at -= length * times
    return used


def pack(lengths: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows for items of the given lengths, all below `window`: lists of (item, from, length); all but the last few are full."""
    waiting: dict[int, list[int]] = {}
    for item in np.argsort(lengths, kind="stable")[::-1].tolist():
        waiting.setdefault(int(lengths[item]), []).append(item)
    start: dict[int, int] = {}
    out: list[list[tuple[int, int, int]]] = []
    order = list(waiting)  # descending
    total = int(lengths.sum())
    counts = {k: len(v) for k, v in waiting.items()}

    def take(length: int) -> tuple[int, int, int]:
        item = waiting[length].pop()
        counts[length] -= 1
        return item, start.get(item, 0), length

    while total >= window:
        order = [k for k in order if counts[k]]
        used = fill(order, counts, window)
        short = window - sum(k * n for k, n in used.items())
        for _ in range(1 if short else min(counts[k] // n for k, n in used.items())):
            bin_ = [take(k) for k, n in used.items() for _ in range(n)]
            total -= sum(p[2] for p in bin_)
            if short:  # the shortest piece that closes the gap is cut; while a whole window is left, there are more
                while short:
                    order = [k for k in order if counts[k]]
                    k = next((k for k in reversed(order) if k >= short), order[0])
                    item, at, length = take(k)
                    cut = min(short, length)
                    bin_.append((item, at, cut))
                    if cut < length:
                        start[item] = at + cut
                        rest = length - cut
                        if not waiting.get(rest):
                            order = sorted({*order, rest}, reverse=True)
                        waiting.setdefault(rest, []).append(item)
                        counts[rest] = counts.get(rest, 0) + 1
                    short -= cut
                    total -= cut
            out.append(bin_)
    rest = [take(k) for k in order for _ in range(counts[k])]
    while total:  # less than one window: cut at powers of two
        size = 1 << (total.bit_length() - 1)
        total -= size
        bin_ = []
        while size:
            item, at, length = rest.pop(0)
            cut = min(size, length)
            bin_.append((item, at, cut))
            if cut < length:
                rest.insert(0, (item, at + cut, length - cut))
            size -= cut
        out.append(bin_)
    return out


def pack_documents(docs: DataFrame, file: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", encoder: Callable = library_encoder) -> DataFrame:
    """One row for each piece: SCHEMA, with the piece's ids as little-endian unsigned 32-bit bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(file), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            rows, remainders, owner = [], [], []
            for doc_id, ids in held:
                n = len(ids) // 4
                for at in range(0, n - window + 1, window):
                    rows.append((doc_id, at, window, ids[4 * at : 4 * (at + window)], n, base, 0))
                    base += 1
                if n % window:
                    remainders.append(n % window)
                    owner.append((doc_id, ids, n, n - n % window))
            for bin_ in pack(np.array(remainders, np.int64), window):
                offset = 0
                for item, at, length in bin_:
                    doc_id, ids, n, begin = owner[item]
                    rows.append((doc_id, begin + at, length, ids[4 * (begin + at) : 4 * (begin + at + length)], n, base, offset))
                    offset += length
                base += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4096], strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                for doc_id, x in zip(ids[k : k + 256], encode(texts[k : k + 256]), strict=True):
                    held.append((doc_id, x + end))
                    size += len(x) // 4 + 1
                if size >= GROUP_IDS:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
