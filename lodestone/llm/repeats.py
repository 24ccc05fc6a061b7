"""Operator 10, suffix-array dedup: repeated byte strings across documents, by common-prefix intervals.

A byte is removed if a string of LENGTH bytes over it also starts in a document with a smaller id. Every such string is
found where its copies meet:

1. Each window of LENGTH bytes is named by its anchor, the k-gram of least hash inside it (a minimizer), which is the same
   wherever the window stands. Neighbouring windows with one anchor are a run; its bytes are the run's context. One
   entry (key, context hash, place) a run is shuffled by key, packed in binary blobs; of equal contexts in one slice of
   a task only those of the smallest document go on.
2. Where entries of a key meet, all later copies of an equal context are covered. Contexts that differ under one key
   may still share windows: the first copies of each ask for their bytes.
3. These bytes meet by key and form one text with an enhanced suffix array: suffixes in order and their common prefixes.
   A stack scan gives the common-prefix intervals; those of LENGTH or more whose left extensions differ are the maximal
   repeats, each with all its occurrences. Occurrences in documents after the first are covered.
4. What is covered is cut from the documents.

Texts are staged once in the shared folder with the number of the part they were written in; what is asked of a part, or
covered in it, is written for that part, and no text is shuffled. Keys that many of a bounded sample of documents have
are split by window (each window its own key), so that no passage that a large share of documents has meets in one task;
the sample decides routes only, never what is found. Such a
window's key and its context are two independent hashes, as the anchor's and the context's are elsewhere: a false copy
needs both to agree, over 100 bits.

Defined results: a null or empty text has no bytes. Rows of one id are one document as to removal: neither is before the
other. A null id is before all others (but the least number there is, with which it counts as one document). An empty table gives an empty result. Texts are cut in slices for memory, not in
meaning.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import col, hash_share, stage_path
from lodestone.llm.part_files import IN_PART, PartFiles, Planes

LENGTH, GRAM = 50, 24
#: Bytes of texts that a task works on at once.
SLICE = 2_000_000
#: Keys in at least this share of at most SAMPLE_DOCUMENTS documents are split by window; at most HOT_KEYS of them.
SAMPLE_DOCUMENTS, HOT_SHARE, HOT_KEYS = 3000, 0.01, 20_000
#: Intervals are found in texts of at most about so many bytes at once, whole keys each (one key may need more).
SUFFIX_BYTES = 4_000_000
#: Bytes of texts for each bucket in which entries meet, and for each task; of tasks, at most so many, which go through their buckets one after another.
BUCKET_BYTES, TASK_BYTES, TASKS = 4_000_000, 8_000_000, 20_000
#: What a null id counts as when documents are put in order.
NULL_ID = -(1 << 63)

_U = np.uint64
_MULTIPLIER, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BITS = 24  # of a position in a slice


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any substrings of a text, by prefix sums; equal for equal bytes. Another multiplier and seed make another function."""

    def __init__(self, data: np.ndarray, multiplier: int = _MULTIPLIER, seed: int = 11):
        n = len(data) + 1
        self.sums = np.append(_U(0), np.cumsum(mix(data.astype(np.uint64) + _U(seed)) * powers(n - 1, multiplier)))
        self.back = powers(n, pow(multiplier, -1, 1 << 64))

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + np.asarray(length).astype(np.uint64))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each position, from words of eight bytes; the text is padded by zeros."""
    padded = np.append(data, np.zeros(gram + 8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + gram].copy().view(np.uint64).ravel()
    out = mix(words[: len(data)])
    for at in sorted({*range(8, gram - 7, 8), gram - 8} - {0}):
        out = mix(out * _U(_MULTIPLIER) + words[at : at + len(data)])
    return out


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a row, which end at `ends`: each run's key, first window and number of windows."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    least = hashes >> _U(_BITS) << _U(_BITS) | np.arange(len(data), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: step - width], least[width - step :])
    anchor = (least[:n] & _U((1 << _BITS) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    starts = np.append(0, ends[:-1])
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    inside = np.cumsum(inside)[:n] > 0
    new = inside & np.append(True, (anchor[1:] != anchor[:-1]) | ~inside[:-1])
    new[starts[long]] = True
    first = np.flatnonzero(new)
    before = np.append(0, np.cumsum(inside))
    count = before[np.append(first[1:], n)] - before[first]
    return hashes[anchor[first]], first, count


def slices(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in a row, of about SLICE bytes: bytes, ends, rows, ids, and each text's offset. Long texts are cut, overlapping by length - 1."""
    held: list[bytes] = []
    info: list[tuple[int, int, int]] = []
    size = 0

    def out():
        rows, ids, offsets = (np.array(c, np.int64) for c in zip(*info, strict=True))
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), rows, ids, offsets

    for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        for at in range(0, max(1, len(text) - length + 1), SLICE):
            part = text[at : at + SLICE + length - 1]
            if size and size + len(part) > SLICE:
                yield out()
                held, info, size = [], [], 0
            held.append(part)
            info.append((row, doc_id, at))
            size += len(part)
    if held:
        yield out()


#: Widths of an entry: key (its low part; the rest chose the bucket), context hash, number of the text in the slice, first window, windows.
ENTRY = (5, 7, 3, 4, 1)
#: Of what is asked of a part: row within the part, first window, windows, key, window by window.
ASKED = (5, 5, 1, 8)
#: Of what is covered in a part: row within the part, first byte, bytes.
COVERED = (5, 5, 5)


#: What cut() gives of each document, before its carried columns.
CUT = "row long, doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def entries(batches: Iterable[pa.RecordBatch], buckets: int, hot: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Blobs of entries for each bucket, and of what is covered within a slice already."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("rows", pa.binary()), ("blob", pa.binary())])
    for batch in batches:
        for data, ends, rows, ids, offsets in slices(batch, length):
            key, first, count = runs(data, ends, length)
            if not len(key):
                continue
            hashes = Hashes(data)
            at = np.searchsorted(hot, key) if len(hot) else None
            if at is not None and (popular := hot[np.minimum(at, len(hot) - 1)] == key).any():
                each = np.repeat(first[popular], count[popular]) + np.arange(count[popular].sum()) - np.repeat(np.cumsum(count[popular]) - count[popular], count[popular])
                key, first, count = np.append(key[~popular], Hashes(data, _OTHER, 29)(each, length)), np.append(first[~popular], each), np.append(count[~popular], np.ones(len(each), np.int64))
            context = hashes(first, count + length - 1) >> _U(8)
            text = np.searchsorted(ends, first, "right")
            # of equal contexts in this slice, those of the smallest id go on; the others are covered
            order = np.lexsort((ids[text], context, key))
            key, first, count, context, text = (x[order] for x in (key, first, count, context, text))
            new = np.append(True, (key[1:] != key[:-1]) | (context[1:] != context[:-1]))
            smallest = ids[text][np.flatnonzero(new)][np.cumsum(new) - 1]
            later = ids[text] > smallest
            out = []
            place = first - np.append(0, ends[:-1])[text] + offsets[text]
            if later.any():
                out += covers(rows[text[later]], place[later], count[later] + length - 1)
            stay = np.flatnonzero(~later)
            stay = stay[np.argsort(key[stay] % _U(buckets), kind="stable")]
            bucket = (key[stay] % _U(buckets)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, np.diff(bucket) != 0)).tolist()
            for a, b in zip(edges, [*edges[1:], len(stay)], strict=True):
                some = stay[a:b]
                some = some[np.lexsort((place[some], text[some]))]
                used, local = np.unique(text[some], return_inverse=True)
                table = Planes.pack((rows[used].view(np.uint64), 8), (ids[used].view(np.uint64), 8))
                out.append({"bucket": int(bucket[a]), "part": None, "rows": table, "blob": Planes.pack((key[some] // _U(buckets), 5), (context[some], 7), (local, 3), (place[some], 4), (count[some], 1))})
            yield batch_of(out, schema)


def covers(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[dict]:
    """What is covered, in a blob for each part; neighbours in one text that meet are joined."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + n)[order]
    number = np.cumsum(np.append(0, row[1:] != row[:-1])) << 36  # rows apart, so that one running maximum serves all
    reach = np.maximum.accumulate(end + number)
    at = np.flatnonzero(np.append(True, start[1:] + number[1:] > reach[:-1]))
    end = reach[np.append(at[1:], len(reach)) - 1] - number[at]
    row, start = row[at], start[at]
    part = row >> 33
    edges = np.flatnonzero(np.append(True, np.diff(part) != 0)).tolist()
    return [{"bucket": None, "part": int(part[a]), "rows": None, "blob": Planes.pack((row[a:b] & IN_PART, 5), (start[a:b], 5), ((end - start)[a:b], 5))} for a, b in zip(edges, [*edges[1:], len(row)], strict=True)]


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one bucket after another; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            for row in batch.slice(at, 32).to_pylist():
                if row["bucket"] != now and held:
                    yield now, held
                    held = []
                now = row["bucket"]
                held.append(row)
    if held:
        yield now, held


def meet(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Entries of a bucket: what is covered, and what is asked, in blobs for each part."""
    schema = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("blob", pa.binary())])
    for _, blobs in by_bucket(batches):
        # keys that stand alone go before anything else is unpacked
        keys = [Planes.unpack(r["blob"], ENTRY[0])[0] for r in blobs]
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        same = key[order][1:] == key[order][:-1]
        again[order[1:][same]] = again[order[:-1][same]] = True
        del key, order, same
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        at = 0
        for r, own in zip(blobs, keys, strict=True):
            some = np.flatnonzero(again[at : at + len(own)])
            at += len(own)
            if len(some):
                rows, ids = Planes.unpack(r["rows"], 8, 8)
                _, context, text, place, count = (x[some] for x in Planes.unpack(r["blob"], *ENTRY))
                for c, x in zip(columns, (own[some], context, ids[text.astype(np.int64)].view(np.int64), rows[text.astype(np.int64)].view(np.int64), place.view(np.int64), count.view(np.int64)), strict=True):
                    c.append(x)
            r.clear()
        del keys, again
        if not columns[0]:
            continue
        key, context, ids, rows, place, count = (np.concatenate(c) for c in columns)
        del columns
        order = np.lexsort((ids, context, key))
        key, context, ids, rows, place, count = (x[order] for x in (key, context, ids, rows, place, count))
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, context[1:] != context[:-1])
        smallest = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = ids > smallest
        out = []
        if later.any():
            out += [r | {"kind": "covered"} for r in covers(rows[later], place[later], count[later] + length - 1)]
        number = np.cumsum(new_key) - 1
        contexts = np.bincount(number, new)
        low, high = (f.reduceat(ids, np.flatnonzero(new_key)) for f in (np.minimum, np.maximum))
        ask = np.flatnonzero(~later & (contexts[number] > 1) & (low != high)[number])
        ask = ask[np.argsort(rows[ask], kind="stable")]
        part = rows[ask] >> 33
        edges = np.flatnonzero(np.append(True, np.diff(part) != 0)).tolist() if len(ask) else []
        for a, b in zip(edges, [*edges[1:], len(ask)], strict=True) if edges else ():
            some = ask[a:b]
            out.append({"kind": "asked", "part": int(part[a]), "blob": Planes.pack((rows[some] & IN_PART, 5), (place[some], 5), (count[some], 1), (key[some], 8))})
        for r in out:
            r.pop("bucket", None)
            r.pop("rows", None)
        if out:
            yield batch_of(out, schema)


def contexts(batches: Iterable[pa.RecordBatch], folder: str, buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """The bytes that were asked for, in blobs by key."""
    schema = pa.schema([("bucket", pa.int32()), ("info", pa.binary()), ("blob", pa.binary())])
    files = PartFiles(folder, ASKED)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            held: list[list] = [[] for _ in range(6)]
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                place, count, key = files.of_row(row)
                for c, x in zip(held, ([text[p : p + n] for p, n in zip(place.tolist(), (count + length - 1).tolist(), strict=True)], key.tolist(), place.tolist(), [row] * len(key), [doc_id] * len(key), (count + length - 1).tolist()), strict=True):
                    c += x
            if not held[0]:
                continue
            key = np.array(held[1], np.int64).view(np.uint64)
            order = np.argsort(mix(key) % _U(buckets), kind="stable")
            bucket = (mix(key[order]) % _U(buckets)).astype(np.int64)
            edges = np.flatnonzero(np.append(True, np.diff(bucket) != 0)).tolist()
            place, row, ids, size = (np.array(c, np.int64) for c in held[2:])
            out = []
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                some = order[a:b]
                out.append({"bucket": int(bucket[a]), "info": Planes.pack(*((x[some].view(np.uint64), 8) for x in (key.view(np.int64), place, row, ids, size))), "blob": b"".join(map(held[0].__getitem__, some.tolist()))})
            yield batch_of(out, schema)


def suffix_order(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes from `start` to `end` in order of their bytes, and each one's common prefix with the one before it.

    Every suffix is short (a context), so it is compared as words of eight bytes, most significant byte first.
    """
    longest = int((end - start).max())
    words = -(-longest // 8)
    padded = np.append(data, np.zeros(8 * words + 8, np.uint8))
    big = np.lib.stride_tricks.sliding_window_view(padded, 8)
    columns = []
    for k in range(words):
        word = big[start + 8 * k].copy().view(">u8").ravel().astype(np.uint64)
        left = np.clip(end - start - 8 * k, 0, 8).astype(np.uint64)
        mask = np.where(left == 0, _U(0), ~_U(0) << ((_U(8) - np.maximum(left, _U(1))) * _U(8)))
        columns.append(word & mask)
    size = end - start
    order = np.lexsort((size, *columns[::-1]))
    common = np.zeros(len(order), np.int64)
    going = np.ones(max(len(order) - 1, 0), bool)
    for column in columns:
        x = column[order]
        differ = x[1:] ^ x[:-1]
        equal = sum(((differ >> _U(8 * k)) == 0).astype(np.int64) for k in range(8))  # leading bytes that don't differ
        common[1:] += np.where(going, equal, 0)
        going &= differ == 0
    ordered = size[order]
    common[1:] = np.minimum(common[1:], np.minimum(ordered[1:], ordered[:-1]))
    return order, common


def intervals(common: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of at least `least`, by one scan with a stack."""
    out = []
    stack: list[tuple[int, int]] = []
    values = common.tolist()
    near = np.flatnonzero(common >= least).tolist()
    ends = {i + 1 for i in near} - set(near)
    for i in sorted({*near, *ends}):
        now = values[i] if i < len(values) and values[i] >= least else 0
        begin = i - 1
        while stack and stack[-1][0] > now:
            size, begin = stack.pop()
            out.append((size, begin, i - 1))
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, begin))
    while stack:
        size, begin = stack.pop()
        out.append((size, begin, len(values) - 1))
    return out


def maximal_repeats(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of texts data[begin:end]: groups (size, text numbers, positions in data) with all occurrences of each maximal repeat.

    A repeat is maximal if longer common prefixes leave occurrences out and its left neighbours differ; a text's
    beginning differs from everything.
    """
    room = np.maximum(end - begin - length + 1, 0)
    text = np.repeat(np.arange(len(begin)), room)
    start = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(room) - room, room)
    if len(start) < 2:
        return []
    order, common = suffix_order(data, start, end[text])
    text, start = text[order], start[order]
    left = np.where(start > begin[text], data[np.maximum(start - 1, 0)].astype(np.int64), 256 + text)
    # where the left neighbour isn't that of the suffix before: an interval without such a place isn't left-diverse
    turns = np.cumsum(np.append(0, left[1:] != left[:-1]))
    out = []
    for size, a, b in intervals(common, length):
        if turns[b] != turns[a]:
            out.append((size, text[a : b + 1], start[a : b + 1]))
    return out


def find(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts of a bucket: what is covered by maximal repeats that also occur in a smaller document."""
    schema = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("blob", pa.binary())])
    for _, blobs in by_bucket(batches):
        info = [np.concatenate(c).view(np.int64) for c in zip(*(Planes.unpack(r["info"], 8, 8, 8, 8, 8) for r in blobs), strict=True)]
        data = np.frombuffer(b"".join(r["blob"] for r in blobs), np.uint8)
        key, place, row, ids, size = info
        end = np.cumsum(size)
        begin = end - size
        # texts none of whose windows stands in another document too can't hold a repeat: they go before the sort
        room = size - length + 1
        owner = np.repeat(np.arange(len(size)), room)
        at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room)
        hashes = Hashes(data)(at, length)
        order = np.argsort(hashes, kind="stable")
        new = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
        low, high = (f.reduceat(ids[owner[order]], new) for f in (np.minimum, np.maximum))
        shared = np.repeat(low != high, np.diff(np.append(new, len(order))))
        keep = np.unique(owner[order[shared]])
        keep = keep[np.argsort(key[keep], kind="stable")]
        turns = np.flatnonzero(np.append(True, key[keep][1:] != key[keep][:-1])).tolist() if len(keep) else []
        rows_out, start_out, n_out = [], [], []
        group: list[int] = []
        weight = 0
        for a, b in zip(turns, [*turns[1:], len(keep)], strict=True) if turns else ():
            group += keep[a:b].tolist()
            weight += int(size[keep[a:b]].sum())
            if weight < SUFFIX_BYTES and b < len(keep):
                continue
            some = np.array(group)
            for length_, text, start in maximal_repeats(data, begin[some], end[some], length):
                which = some[text]
                later = ids[which] > ids[which].min()
                rows_out.append(row[which[later]])
                start_out.append((place[which] + start - begin[which])[later])
                n_out.append(np.full(later.sum(), length_))
            group, weight = [], 0
        if rows_out and sum(map(len, rows_out)):
            out = covers(np.concatenate(rows_out), np.concatenate(start_out), np.concatenate(n_out))
            yield batch_of([{"kind": "covered", "part": r["part"], "blob": r["blob"]} for r in out], schema)


def cut(batches: Iterable[pa.RecordBatch], folder: str, carried: list[str], whole_characters: bool) -> Iterator[pa.RecordBatch]:
    """The covered spans of each text, and what is left of it. whole_characters: spans shrink to the characters that they cover whole."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    files = PartFiles(folder, COVERED)
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            found, left = [], []
            texts = batch.column("text").to_pylist()
            for row, text in zip(batch.column("row").to_pylist(), texts, strict=True):
                start, n = files.of_row(row)
                spans, kept = [], text
                if len(start):
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate((start + n)[order])
                    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
                    spans = list(zip(start[new].tolist(), reach[np.append(new[1:], len(reach)) - 1].tolist(), strict=True))
                    if whole_characters:
                        spans = [(a, b) for a, b in (within(text, *s) for s in spans) if a < b]
                    kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)], strict=True))
                found.append([{"start": a, "end": b} for a, b in spans])
                left.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(found, spans_type), pa.array(left, pa.binary()), *(batch.column(c) for c in carried)],
                names=["row", "doc_id", "n_bytes", "spans", "kept", *carried])


def within(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The part of a span from the beginning of a UTF-8 character to the end of one."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def hot_keys(staged: DataFrame, n_docs: int, length: int) -> np.ndarray:
    """Keys that a sample of documents has often; at most HOT_KEYS, sorted."""
    sample = staged.where(hash_share(F.col("row"), SAMPLE_DOCUMENTS / max(n_docs, 1)))

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, *_ in slices(batch, length):
                key, first, _ = runs(data, ends, length)
                pairs = np.unique(np.stack([key.view(np.int64), np.searchsorted(ends, first, "right")]), axis=1)
                found, n = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], names=["key", "n"])

    often = sample.mapInArrow(keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(10, HOT_SHARE * min(n_docs, SAMPLE_DOCUMENTS)))
    return np.sort(np.array([r.key for r in often.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()], np.int64).view(np.uint64))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """row, doc_id, n_bytes, spans, kept, and the carried columns as carried_0, carried_1, ...: one row for each document."""
    spark = docs.sparkSession
    folder = stage_path(spark, "repeats")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"), *(col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))
    schema = rows.schema
    rows.write.option("compression", "zstd").parquet(f"{folder}/texts")
    texts = spark.read.schema(schema).parquet(f"{folder}/texts")
    staged = texts.select("row", "doc_id", "text")
    total = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, total.bytes // TASK_BYTES))
    buckets = max(2 * partitions, total.bytes // BUCKET_BYTES)
    hot = hot_keys(staged, total.n, length)

    kinds = "bucket int, part long, rows binary, blob binary"
    met = staged.mapInArrow(lambda b: entries(b, buckets, hot, length), kinds)
    # what is covered within a slice has no bucket and passes through, by its part
    routed = met.withColumn("to", F.coalesce(F.col("bucket"), F.pmod(F.col("part"), F.lit(buckets)).cast("int"))).repartition(partitions, "to").sortWithinPartitions(F.col("bucket").asc_nulls_first()).select("bucket", "part", "rows", "blob")

    def first_meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ahead() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flags = pc.is_null(batch.column("bucket"))
                passed.append(batch.filter(flags))
                yield batch.filter(pc.invert(flags))

        passed: list[pa.RecordBatch] = []
        for out in meet(ahead(), length):
            yield out
        for batch in passed:
            yield pa.RecordBatch.from_arrays([pa.array(["covered"] * batch.num_rows, pa.string()), batch.column("part"), batch.column("blob")], names=["kind", "part", "blob"])

    blobs = "kind string, part long, blob binary"

    def write(df: DataFrame, name: str) -> None:
        df.repartition(partitions, "part").write.partitionBy("kind", "part").parquet(f"{folder}/{name}")

    write(routed.mapInArrow(first_meeting, blobs), "first")
    asked = staged.mapInArrow(lambda b: contexts(b, f"{folder}/first/kind=asked", buckets, length), "bucket int, info binary, blob binary")
    found = asked.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: find(b, length), blobs)
    earlier = spark.read.schema("blob binary, kind string, part long").parquet(f"{folder}/first").where("kind = 'covered'").select("kind", "part", "blob")
    write(found.unionByName(earlier), "second")
    carried = [f"carried_{k}" for k in range(len(carry))]
    return texts.mapInArrow(lambda b: cut(b, f"{folder}/second/kind=covered", carried, whole_characters), StructType([*StructType.fromDDL(CUT), *(schema[c] for c in carried)]))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, n_chars_col: str = "n_chars") -> DataFrame:
    """`docs` with the repeated strings cut from the texts, whole characters only; a column n_chars of numbers follows the text."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    rows = cut_repeats(docs, id_col, text_col, length, others, whole_characters=True)
    named = {id_col: F.col("doc_id"), text_col: F.col("kept").cast("string")} | {c: F.col(f"carried_{k}") for k, c in enumerate(others)}
    if n_chars_col in others:
        named[n_chars_col] = F.length(named[text_col]).cast(docs.schema[n_chars_col].dataType)
    return rows.select(*(named[c].alias(c) for c in docs.columns))
