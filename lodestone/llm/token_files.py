"""Operator 6, token-id files: equal-length sequences and masks in Arrow's file format, with zero-copy random access.

All documents' ids, each with the end id, are one stream in ascending order of doc_id. The stream is cut into shards by
ranges of doc_id, each a folder-level file of record batches (the last may be shorter) of BATCH sequences:

    shard-<number>.arrow       ids  fixed_size_list<uint16 or uint32>[length], mask fixed_size_list<bool>[length]
    shard-<number>.docs.arrow  doc_id, start (within the shard), n_tokens

Only a shard's last sequence is padded, with id 0 and a false mask. A sequence is at a fixed place: batch i // BATCH, row
i % BATCH; a memory-mapped file gives it as a view, without a copy or a decode. The narrower type is used if the
vocabulary fits it. A task writes to a name of its own and then moves the file, so a task that runs twice leaves one
whole file; the manifest with each shard's counts is written by Spark.

Defined results: a null or empty text has the end id alone. Documents of one id stand together, in the order of their
texts' hashes; a null id stands first. An empty table gives an empty manifest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import id_text
from lodestone.llm.tokens import library_encoder

LENGTH, BATCH, END_ID = 1024, 1024, 0
#: Documents of a shard, on average; shards, at most (a shard is streamed, so it may be of any size).
SHARD_DOCUMENTS, MAX_SHARDS = 8192, 10_000
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_sequences long"


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri.removeprefix("file:"))


def schema(length: int, dtype: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(dtype, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Streams documents' ids into one shard's two files; holds one batch."""

    def __init__(self, folder: str, number: int, attempt: str, length: int, dtype: pa.DataType):
        self.fs, base = file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.final = [f"{base}/shard-{number:08d}{end}" for end in (".arrow", ".docs.arrow")]
        self.held = [f"{base}/.{attempt}-{number:08d}{end}" for end in (".arrow", ".docs.arrow")]
        self.streams = [self.fs.open_output_stream(p) for p in self.held]
        self.length, self.dtype = length, dtype
        self.writers = [pa.ipc.new_file(self.streams[0], schema(length, dtype)), pa.ipc.new_file(self.streams[1], DOCS)]
        self.buffer: list[np.ndarray] = []
        self.buffered = self.tokens = self.docs = self.sequences = 0
        self.rows: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.tokens, len(ids)))
        self.buffer.append(ids)
        self.tokens += len(ids)
        self.buffered += len(ids)
        self.docs += 1
        if self.buffered >= BATCH * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.buffer) if self.buffer else np.zeros(0, self.dtype.to_pandas_dtype())
        whole = BATCH * self.length
        at = 0
        while len(ids) - at >= whole or (last and at < len(ids)):
            part = ids[at : at + whole]
            at += len(part)
            n = -(-len(part) // self.length)
            flat = np.zeros(n * self.length, self.dtype.to_pandas_dtype())
            flat[: len(part)] = part
            mask = pa.array(np.arange(n * self.length) < len(part))
            lists = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(flat, self.dtype), mask)]
            self.writers[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=schema(self.length, self.dtype)))
            self.sequences += n
        self.buffer = [ids[at:]]
        self.buffered = len(ids) - at
        if self.rows:
            self.writers[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=DOCS))
            self.rows = []

    def close(self) -> str:
        self.flush(True)
        for x in [*self.writers, *self.streams]:
            x.close()
        for a, b in zip(self.held, self.final, strict=True):
            self.fs.move(a, b)
        return self.final[0]


def write_files(docs: DataFrame, file: str, folder: str, vocabulary_size: int, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", encoder: Callable = library_encoder) -> DataFrame:
    """Write the shards and <folder>/manifest; MANIFEST, one row for each shard. One shuffle, of texts by ranges of id."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    shards = min(MAX_SHARDS, max(1, -(-rows.count() // SHARD_DOCUMENTS)))
    dtype = pa.uint16() if vocabulary_size <= 1 << 16 else pa.uint32()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(file), TaskContext.get()
        end = np.array([end_id], "<u4").tobytes()
        writer = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                writer = writer or ShardWriter(folder, task.partitionId(), str(task.taskAttemptId()), length, dtype)
                for doc_id, x in zip(ids[k : k + 256], encode(texts[k : k + 256]), strict=True):
                    writer.add(doc_id, np.frombuffer(x + end, "<u4").astype(dtype.to_pandas_dtype()))
        if writer:
            path = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": path, "n_docs": writer.docs, "n_tokens": writer.tokens, "n_sequences": writer.sequences}])

    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


@dataclass
class Shard:
    """One shard opened for reading: mapped into memory if its file is local."""

    source: pa.NativeFile
    reader: pa.ipc.RecordBatchFileReader
    length: int

    @classmethod
    def open(cls, fs: arrow_fs.FileSystem, path: str) -> Shard:
        source = pa.memory_map(path) if isinstance(fs, arrow_fs.LocalFileSystem) else fs.open_input_file(path)
        reader = pa.ipc.open_file(source)
        return cls(source, reader, reader.schema.field("ids").type.list_size)

    def flat(self, batch: int) -> np.ndarray:
        """The ids of a batch, one sequence after another; a view."""
        return self.reader.get_batch(batch).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i of the shard and its mask, both views."""
        batch = self.reader.get_batch(i // BATCH)
        row = i % BATCH
        return batch.column("ids")[row].values.to_numpy(zero_copy_only=True), batch.column("mask")[row].values

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids of the stream from `start`; a view unless they lie in two batches."""
        whole, parts = BATCH * self.length, []
        while n:
            flat = self.flat(start // whole)
            parts.append(flat[start % whole : start % whole + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files.

    The manifest, at most MAX_SHARDS rows, is read by the driver, which adds up the shards' starts.
    """
    shards = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: r.shard)
    before = np.cumsum([0, *(r.n_tokens for r in shards)]).tolist()
    frame = spark.createDataFrame([(r.path, b) for r, b in zip(shards, before, strict=False)], "path string, before long").repartition(max(1, len(shards)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                shard = Shard.open(fs, path)
                with fs.open_input_file(path.removesuffix(".arrow") + ".docs.arrow") as f:
                    index = pa.ipc.open_file(f)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        for at in range(0, part.num_rows, 1024):
                            rows = part.slice(at, 1024)
                            starts, counts = rows.column("start").to_pylist(), rows.column("n_tokens")
                            ids = [shard.span(s, n).astype("<u4").tobytes() for s, n in zip(starts, counts.to_pylist(), strict=True)]
                            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([base + s for s in starts], pa.int64()), counts, pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return frame.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
