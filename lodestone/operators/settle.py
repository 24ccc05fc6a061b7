"""Intermediate results that several parts of a plan read: computed once, kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> None:
    """Sets a temporary checkpoint folder on a single machine that has none, as in tests; elsewhere spark.checkpoint.dir must name one."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(path)


def settled(df: DataFrame) -> DataFrame:
    """`df` as a checkpoint: plans that use it don't repeat how it was made, and a lost executor costs no recomputation.

    The folder is spark.checkpoint.dir.
    """
    _folder(df)
    return df.checkpoint()


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """`df` as Parquet in the same folder, for wide tables: compressed columns, of which a plan reads those it needs. `by`: a column whose values are read apart."""
    _folder(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip('/')}/staged-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
