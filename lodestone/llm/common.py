"""What the operators of this subpackage share: staging in the cluster's shared folder, and input projection."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on a single machine, as in tests, a temporary folder is set as it; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; the open scope, if any, owns it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.folders.append(path)
    return path


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """Owns the folders staged while it is open, by its thread alone; at its end they are deleted, but for the frames handed on by keep().

    Scopes nest: what is kept goes to the scope around, or, where there is none, stays as long as the shared folder does,
    like any checkpoint, since a frame that a caller holds may read it at any time.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: list[str] = []
        self.kept: set[str] = set()

    def __enter__(self) -> Scope:
        self._token = _SCOPE.set(self)
        return self

    @contextmanager
    def held(self) -> Iterator[None]:
        """Owns what is staged inside, and stays open after it."""
        token = _SCOPE.set(self)
        try:
            yield
        finally:
            _SCOPE.reset(token)

    def keep(self, *frames: DataFrame) -> None:
        self.kept |= {df._staged for df in frames}

    def drop(self, *frames: DataFrame) -> None:
        """Delete frames of this scope that nothing reads any more."""
        for path in (df._staged for df in frames):
            self.folders.remove(path)
            delete_folder(self.spark, path)

    def close(self) -> None:
        for path in self.folders:
            if path not in self.kept:
                delete_folder(self.spark, path)
        self.folders = []

    def __exit__(self, *_: object) -> None:
        _SCOPE.reset(self._token)
        around = _SCOPE.get()
        if around is not None:
            around.folders += [p for p in self.folders if p in self.kept]
        self.close()


_SCOPE: ContextVar[Scope | None] = ContextVar("lodestone_scope", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def reread(staged: DataFrame, spark: SparkSession) -> DataFrame:
    """A staged table as another session reads it."""
    out = spark.read.schema(staged.schema).parquet(staged._staged)
    out._staged = staged._staged
    return out


def small_batches(spark: SparkSession, rows: int = 1024, mb: int = 8) -> SparkSession:
    """A copy of the session that sends Python workers batches of at most so many rows, and about so many MB. Queries in the given one keep their batches."""
    out = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    out.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    out.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text; other columns, whatever their names, don't reach the operator. Null text becomes empty."""
    return docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))


def hash_share(column: Column, share: float) -> Column:
    """True for about `share` of the distinct values, the same ones in every run."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def per_worker(key: tuple, make: Callable):
    """What `make` gives, once for each Python worker and key: it outlives the task, as functions travel by value."""
    held = sys.__dict__.setdefault("_lodestone_held", {})
    if key not in held:
        held[key] = make()
    return held[key]
