"""The training-data pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. What a stage stages belongs to that stage alone: it is
deleted when the next stage of the same thread begins, as its result has been written by then; run() deletes it, and the
rows before it, as soon as the next rows are written. The last stage stages nothing but reads the rows before it.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import near_dedup, packing, quality_classifier, quality_rules, repeats
from lodestone.llm.common import Scope, delete_folder, stage_path
from lodestone.llm.tokens import fixed_path

#: SQL has no form of the trained scorer, of hashing or of packing; tests hold the stages against brute force.
ORACLE_SQL = None

#: What the stage called last in this thread had staged.
_STAGE: ContextVar[Scope | None] = ContextVar("pipeline_stage", default=None)


def own_scope(first: bool = False) -> Callable:
    """Gives a stage a scope of its own; the stage before it, whose result is written by now, loses what it had staged."""

    def wrap(step: Callable) -> Callable:
        @wraps(step)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = _STAGE.get()
            if before is not None and before.spark is spark and not first:
                before.close()
            scope = Scope(spark)
            _STAGE.set(scope)
            with scope.held():
                return step(spark, docs, sf_dir)

        return run_stage

    return wrap


@own_scope(first=True)
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer finds bad go."""
    scored = quality_classifier.apply(docs, quality_classifier.fit(docs), score_col="__quality_score", keep_col="__quality_kept")
    return scored.where("__quality_kept").drop("__quality_score", "__quality_kept")


@own_scope()
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a cutoff of their language go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@own_scope()
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id."""
    return near_dedup.keep_one(docs)


@own_scope()
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that an earlier document has too are cut from the texts."""
    return repeats.without_repeats(docs)


@own_scope()
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of equal length."""
    pieces = packing.pack_documents(docs, fixed_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = stage_path(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            _STAGE.get().close()
            if before:
                delete_folder(spark, before)
            before = path
    return docs
