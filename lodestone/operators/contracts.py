"""Contracts of tables: checks as aggregates, one small row of findings each; errors are raised from those."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """A table breaks its contract."""


class CandidateError(ValueError):
    """Candidates break theirs."""


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    if missing := sorted(set(required) - set(df.columns)):
        raise SchemaError(f"missing columns: {', '.join(missing)}")


def bad_ids(df: DataFrame, column: str, length: int = 16) -> DataFrame:
    """One row: ids that are null or of another length."""
    return df.agg(F.count_if(F.col(column).isNull() | (F.length(column) != length)).alias("bad_ids"))


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: keys that stand more than once."""
    return df.groupBy(*columns).count().where("count > 1").agg(F.count("*").alias("duplicate_keys"))


def domain_report(df: DataFrame, numeric: Sequence[str], flags: Sequence[str] = ()) -> DataFrame:
    """One row: for each numeric column, values that aren't numbers; for each flag, values but 0 and 1."""
    aggs = [F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast("double").isNull()).alias(f"{c}_invalid") for c in numeric]
    return df.agg(*aggs, *(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)).alias(f"{c}_not_binary") for c in flags))


@dataclass(frozen=True)
class TableContract:
    required: tuple[str, ...]
    id_columns: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()

    def report(self, df: DataFrame) -> DataFrame:
        """rows, null or malformed ids of each id column, duplicate keys."""
        require_columns(df, self.required)
        out = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull() | (F.length(c) != 16)).alias(f"{c}_bad") for c in self.id_columns))
        return out.crossJoin(duplicate_keys(df, self.unique)) if self.unique else out.withColumn("duplicate_keys", F.lit(0))

    def validate(self, df: DataFrame) -> dict:
        found = self.report(df).first().asDict()
        if not found["rows"]:
            raise SchemaError("the table is empty")
        if broken := {k: v for k, v in found.items() if k != "rows" and v}:
            raise SchemaError(str(broken))
        return found


def candidate_report(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """One row: scores that aren't finite, ranks below 1, duplicate triples, unknown items, groups whose ranks have gaps."""
    plain = candidates.agg(F.count("*").alias("rows"), F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("bad_scores"), F.count_if(F.col("rank").isNull() | (F.col("rank") < 1)).alias("bad_ranks"))
    unknown = candidates.join(items.select("item_id"), "item_id", "left_anti").agg(F.count("*").alias("unknown_items"))
    groups = candidates.groupBy("query_id", "source").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.count_distinct("rank").alias("d"))
    gaps = groups.agg(F.count_if((F.col("n") != F.col("m")) | (F.col("n") != F.col("d"))).alias("groups_with_gaps"))
    return plain.crossJoin(duplicate_keys(candidates, ["query_id", "item_id", "source"])).crossJoin(unknown).crossJoin(gaps)


def validate_candidates(candidates: DataFrame, items: DataFrame, allow_empty: bool = False) -> None:
    require_columns(candidates, ("query_id", "item_id", "source", "score", "rank"))
    found = candidate_report(candidates, items).first().asDict()
    if not found["rows"] and not allow_empty:
        raise CandidateError("no candidates")
    if broken := {k: v for k, v in found.items() if k != "rows" and v}:
        raise CandidateError(str(broken))


def negatives_report(negatives: DataFrame, positives: DataFrame, items: DataFrame, cap: int) -> DataFrame:
    """One row: duplicates, positives among them, queries over the cap, unknown items."""
    overlap = negatives.join(positives, ["query_id", "item_id"], "left_semi").agg(F.count("*").alias("positives"))
    over = negatives.groupBy("query_id").count().agg(F.count_if(F.col("count") > cap).alias("queries_over_cap"))
    unknown = negatives.join(items, "item_id", "left_anti").agg(F.count("*").alias("unknown_items"))
    return duplicate_keys(negatives, ["query_id", "item_id"]).crossJoin(overlap).crossJoin(over).crossJoin(unknown)


def ground_truth_relation(truth: DataFrame) -> DataFrame:
    """query_id, item_id of a ground truth in which no pair stands twice."""
    if not truth.groupBy("query_id", "item_id").count().where("count > 1").isEmpty():
        raise SchemaError("a pair of the ground truth stands twice")
    return truth.select("query_id", "item_id")


def oof_report(table: DataFrame) -> DataFrame:
    """One row: rows, repeated keys (fold, query_id, item_id), distinct folds, the least and greatest of them, labels but 0 and 1, positives."""
    require_columns(table, ("fold", "query_id", "item_id", "label"))
    wrong = F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1))
    rows = table.agg(F.count("*").alias("rows"), F.count_distinct(F.col("fold").cast("int")).alias("folds"), F.min(F.col("fold").cast("int")).alias("first_fold"), F.max(F.col("fold").cast("int")).alias("last_fold"), wrong.alias("bad_labels"), F.count_if(F.col("label") == 1).alias("positives"))
    return rows.crossJoin(duplicate_keys(table, ["fold", "query_id", "item_id"]))


def verify_oof(table: DataFrame, folds: int = 3) -> dict:
    """Rows, folds and positives of an out-of-fold table whose keys are unique, whose folds are 0 .. folds - 1 and whose labels are 0 and 1."""
    found = oof_report(table).first().asDict()
    if found["duplicate_keys"] or found["bad_labels"] or (found["folds"], found["first_fold"], found["last_fold"]) != (folds, 0, folds - 1):
        raise SchemaError(str(found))
    return {k: found[k] for k in ("rows", "folds", "positives")} | {"status": True}


def hard_training_rows(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Negatives with label 0, if none stands twice and none is a known positive."""
    for df in (positives, negatives):
        require_columns(df, ("query_id", "item_id"))
    if not negatives.groupBy("query_id", "item_id").count().where("count > 1").isEmpty():
        raise SchemaError("a hard negative stands twice")
    if not negatives.join(positives.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi").isEmpty():
        raise SchemaError("a known positive is a hard negative")
    return negatives.withColumn("label", F.lit(0))


def submission_report(answers: DataFrame, queries: DataFrame, items: DataFrame, exactly: int | None = None, at_most: int = 50) -> DataFrame:
    """One row about rows (query_id, answer of space-joined ids): queries missing, unknown or answered twice, lists of a wrong length, repeated or unknown ids."""
    split = answers.withColumn("ids", F.filter(F.split("answer", " "), lambda x: x != ""))
    wrong = (F.size("ids") != exactly) if exactly is not None else (F.size("ids") > at_most)
    lists = split.agg(F.count("*").alias("answers"), F.count_if(wrong).alias("wrong_length"), F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))).alias("repeated"), F.count_if(F.array_join("ids", " ") != F.col("answer")).alias("bad_spacing"))
    missing = queries.join(answers, "query_id", "left_anti").agg(F.count("*").alias("missing_queries"))
    extra = answers.join(queries, "query_id", "left_anti").agg(F.count("*").alias("unknown_queries"))
    unknown = split.select(F.explode("ids").alias("item_id")).join(items, "item_id", "left_anti").agg(F.count("*").alias("unknown_items"))
    twice = duplicate_keys(answers, ["query_id"]).withColumnRenamed("duplicate_keys", "repeated_queries")
    return lists.crossJoin(missing).crossJoin(extra).crossJoin(unknown).crossJoin(twice)
