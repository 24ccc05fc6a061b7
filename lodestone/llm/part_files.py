"""Numbers in compact blobs, and small tables that are read back by the part of a staged table that they belong to.

A staged table's rows are named by monotonically_increasing_id: the high bits are the part that wrote them. What is found
about some rows goes to files by part, and a map over the staged table reads each part's own: no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.token_files import file_system

IN_PART = (1 << 33) - 1


class Planes:
    """Columns of numbers in planes of bytes, each of which compresses by itself."""

    @staticmethod
    def pack(*columns: tuple[np.ndarray, int]) -> bytes:
        n = len(columns[0][0])
        return np.array([n], "<u4").tobytes() + b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T).tobytes() for x, width in columns)

    @staticmethod
    def unpack(blob: bytes, *widths: int) -> list[np.ndarray]:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        at, out = 4, []
        for width in widths:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            at += n * width
            out.append(wide.view("<u8").ravel())
        return out


class PartFiles:
    """Blobs of one table, partitioned by part in a shared folder; two parts are held at a time."""

    def __init__(self, folder: str, widths: tuple[int, ...]):
        self.widths = widths
        self.fs, self.base = file_system(folder)
        self.held: dict[int, list[np.ndarray]] = {}

    def __call__(self, part: int) -> list[np.ndarray]:
        """The part's columns, sorted by the first, the row within the part."""
        if part not in self.held:
            if len(self.held) > 1:
                self.held.clear()
            found = self.fs.get_file_info(arrow_fs.FileSelector(f"{self.base}/part={part}", allow_not_found=True))
            blobs: list[bytes] = []
            for info in found:
                if info.path.endswith(".parquet"):
                    with self.fs.open_input_file(info.path) as f:
                        blobs += pq.ParquetFile(f).read(columns=["blob"]).column("blob").to_pylist()
            columns = [Planes.unpack(b, *self.widths) for b in blobs]
            joined = [np.concatenate(c).view(np.int64) for c in zip(*columns, strict=True)] if columns else [np.zeros(0, np.int64) for _ in self.widths]
            order = np.argsort(joined[0], kind="stable")
            self.held[part] = [c[order] for c in joined]
        return self.held[part]

    def of_row(self, row: int) -> list[np.ndarray]:
        """The row's entries, without the first column."""
        columns = self(row >> 33)
        a, b = np.searchsorted(columns[0], [row & IN_PART, (row & IN_PART) + 1])
        return [c[a:b] for c in columns[1:]]

    def has(self, rows: np.ndarray) -> np.ndarray:
        """Which rows have an entry."""
        out = np.zeros(len(rows), bool)
        for part in np.unique(rows >> 33).tolist():
            mine = np.flatnonzero(rows >> 33 == part)
            out[mine] = np.isin(rows[mine] & IN_PART, self(part)[0])
        return out


def write_rows(rows: DataFrame, folder: str, partitions: int) -> None:
    """A table of row names (column row), in blobs by part."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row = batch.column("part").to_numpy(), batch.column("row").to_numpy()
            for p in np.unique(part).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([Planes.pack((row[part == p] & IN_PART, 5))], pa.binary())], names=["part", "blob"])

    named = rows.select(F.shiftright("row", 33).alias("part"), "row")
    named.repartition(partitions, "part").mapInArrow(pack, "part long, blob binary").write.partitionBy("part").parquet(folder)


def filter_rows(staged: DataFrame, folder: str, keep: bool) -> DataFrame:
    """The rows of a staged table (column row) that stand in the files of write_rows, or those that don't."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = PartFiles(folder, (5,))
        for batch in batches:
            listed = files.has(batch.column("row").to_numpy())
            yield batch.filter(pa.array(listed if keep else ~listed))

    return staged.mapInArrow(run, staged.schema)
