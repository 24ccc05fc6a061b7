"""Operator 4, byte-level BPE encoding and decoding, by padded matrices.

A text is split by the vocabulary's pattern. Matches that a worker hasn't met are put by length into padded matrices of
byte ids, one row each. In every round every row merges its leftmost pair of minimum rank: a hashed pair table gives the
rank of each neighbouring pair, argmin finds the pair, the row is compacted by one column and only the two pairs beside
the merge are looked up anew. Rows without a pair that merges leave the matrix.

Defined results: a null or empty text has no ids and decodes to no bytes. Repeated rows and null ids are encoded each by
itself; an empty table gives an empty result. Special strings are ordinary text. Matches over LONGEST_ROW bytes, for
which a round a merge would take quadratic time, merge in the same order with a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestone.llm.common import id_text, per_worker
from lodestone.llm.tokens import PieceCache, pattern

LONGEST_ROW = 1024
#: Cells of a matrix.
CELLS = 1 << 20
NONE = np.int64(1 << 40)


class PairTable:
    """Pairs of ids to the id that they merge to, by open addressing in numpy arrays; the id is the rank."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        key = np.array([a << 32 | b for a, b in pairs], np.uint64)
        value = np.array(list(pairs.values()), np.int64)
        at = self.slot(key)
        while len(key):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = key[free]  # of several for one slot, the last stays; the others go on
            self.values[at[free]] = value[free]
            placed = self.keys[at] == key
            key, value, at = key[~placed], value[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where a pair doesn't merge or either side is padding (below 0)."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        at = self.slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.values[at], NONE)
        again = np.flatnonzero((held != key) & (held != self.EMPTY))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[again]]
            hit = held == key[again]
            out[again[hit]] = self.values[at[again[hit]]]
            again = again[~hit & (held != self.EMPTY)]
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs, self.table = pairs, PairTable(pairs)
        self.split = regex.compile(pattern()).findall
        self.encode = PieceCache(self.texts, self.texts)

    def matches(self, matches: list[bytes]) -> list[bytes]:
        """ids (little-endian unsigned 32-bit bytes) of matches, each merged alone."""
        out: list[bytes] = [b""] * len(matches)
        by_width: dict[int, list[int]] = {}
        for i, m in enumerate(matches):
            if len(m) > LONGEST_ROW:
                out[i] = self.long(m)
            elif m:
                n = len(m)
                by_width.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                self.matrix(width, rows[at : at + step], matches, out)
        return out

    def matrix(self, width: int, rows: list[int], matches: list[bytes], out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(matches[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        length = np.array([len(matches[i]) for i in rows], np.int64)
        ids = np.where(np.arange(width) < length[:, None], self.of_byte[raw], -1)
        row = np.array(rows, np.int64)
        rank = self.ranks(ids)
        while True:
            best = rank.argmin(1) if ids.shape[1] > 1 else np.zeros(len(ids), np.int64)
            least = np.take_along_axis(rank, best[:, None], 1)[:, 0] if ids.shape[1] > 1 else np.full(len(ids), NONE)
            done = least == NONE
            if done.any():
                kept = ids[done]
                for i, x, n in zip(row[done].tolist(), kept.astype("<u4"), (kept >= 0).sum(1).tolist(), strict=True):
                    out[i] = x[:n].tobytes()
                live = ~done
                ids, rank, row, best, least = ids[live], rank[live], row[live], best[live], least[live]
                if not len(ids):
                    return
            n, every = ids.shape[1], np.arange(len(ids))
            ids[every, best] = least
            stay = np.ones(ids.shape, bool)
            stay[every, best + 1] = False
            ids = ids[stay].reshape(len(ids), n - 1)
            rank = rank[stay[:, 1:]].reshape(len(ids), n - 2)  # the merged pair's own column goes
            if n > 2:
                for shift in (-1, 0):
                    at = best + shift
                    ok = (at >= 0) & (at < n - 2)
                    r, c = every[ok], at[ok]
                    rank[r, c] = self.look(ids[r, c], ids[r, c + 1])

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        return self.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), ids.shape[1] - 1)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table(left, right)

    def long(self, match: bytes) -> bytes:
        ids = self.of_byte[np.frombuffer(match, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get = self.pairs.get
        heap = [(r, i) for i in range(len(ids) - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= len(ids) or get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, None
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (x := get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := get((ids[before[i]], r))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x in ids if x is not None], "<u4").tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Split by the pattern, and merge each distinct match once."""
        split = list(map(self.split, texts))
        words = list(set().union(*split))
        ids = dict(zip(words, self.matches([w.encode() for w in words]), strict=True))
        return [ids[found[0]] if len(found) == 1 else b"".join(map(ids.__getitem__, found)) for found in split]


class Decoder:
    """ids to bytes: the tokens' bytes stand in one array, and a gather copies them out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.length = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        self.length[list(ranks.values())] = list(map(len, ranks))
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)
        return self.blob[at], ends


def read_ranks(file: str) -> dict[bytes, int]:
    """From a file of lines with a token in base 64 and its rank."""
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def load(file: str) -> ByteBPE:
    """One for each worker."""
    return per_worker(("bpe", file), lambda: ByteBPE(read_ranks(file)))


def encode_batches(batches: Iterable[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    """doc_id, text to doc_id, ids."""
    encode = load(file).encode
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            ids = encode(part.column("text").to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))], names=["doc_id", "ids"])


def decode_batches(batches: Iterable[pa.RecordBatch], file: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids to doc_id, ids, decoded."""
    decode = per_worker(("decoder", file), lambda: Decoder(read_ranks(file)))
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            lists = batch.column("ids")
            counts = np.array(lists.value_lengths().fill_null(0), np.int64)
            decoded, ends = decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
            binary = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(decoded)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, binary], names=["doc_id", "ids", "decoded"])


def encode_texts(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: one row for each document; a map without a shuffle."""
    return id_text(docs, id_col, text_col).mapInArrow(lambda batches: encode_batches(batches, file), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id, ids, decoded binary."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: decode_batches(batches, file), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_texts, then decode_ids, in one worker instead of two."""
    return id_text(docs, id_col, text_col).mapInArrow(lambda batches: decode_batches(encode_batches(batches, file), file), "doc_id long, ids array<int>, decoded binary")
