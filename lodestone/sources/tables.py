"""Scans and sinks of tables, indexes, embeddings and submissions."""

from __future__ import annotations

import hashlib
import json
import tomllib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import table_fingerprint
from lodestone.operators.contracts import SchemaError, bad_ids, submission_report, validate_candidates


class ConfigError(ValueError):
    """A configuration is missing or malformed."""


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """A Parquet scan; only the columns named are read."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def load_ids(spark: SparkSession, path: str, column: str, length: int = 16) -> DataFrame:
    ids = load_table(spark, path, [column])
    if bad := bad_ids(ids, column, length).first()[0]:
        raise SchemaError(f"{bad} malformed values of {column}")
    return ids


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    """A submission as text: query_id, answer; an empty answer is an empty text."""
    return spark.read.option("header", True).option("emptyValue", "").schema("query_id string, answer string").csv(path).fillna("", ["answer"])


@dataclass(frozen=True)
class Config:
    values: dict
    root: Path

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.values, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def path(self, value: str) -> Path:
        return Path(value) if Path(value).is_absolute() else self.root / value


def load_config(path: str, seed: int = 42) -> Config:
    try:
        values = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(str(e)) from e
    values.setdefault("seed", seed)
    if not isinstance(values["seed"], int):
        raise ConfigError("seed isn't a whole number")
    return Config(values, Path(values.get("root", Path(path).resolve().parent)))


def write_sorted(df: DataFrame, path: str, keys: Sequence[str] | None = None) -> None:
    """Parquet in a total order of rows, by ranges: files follow one another, and none holds all."""
    columns = list(keys or df.columns)
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def fingerprint(df: DataFrame) -> str:
    """The same for the same rows in any order."""
    return df.agg(F.concat_ws(":", F.count("*").cast("string"), table_fingerprint(df.columns)).alias("f")).first().f


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system and the path of a name, local or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.exists(at)


def replace(spark: SparkSession, waiting: str, path: str) -> None:
    """Moves what is ready into place; what stood there is set aside first, and comes back if the move fails."""
    fs, new = _hadoop(spark, waiting)
    _, at = _hadoop(spark, path)
    _, aside = _hadoop(spark, path.rstrip("/") + ".before")
    fs.delete(aside, True)
    held = fs.exists(at) and fs.rename(at, aside)
    if not fs.rename(new, at):
        if held:
            fs.rename(aside, at)
        raise OSError(f"can't move {waiting} to {path}")
    fs.delete(aside, True)


def write_bytes(spark: SparkSession, value: bytes, path: str) -> None:
    """All or nothing: a file of another name is moved into place."""
    waiting = f"{path}.{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, waiting)
    fs.mkdirs(at.getParent())
    out = fs.create(at, True)
    try:
        out.write(value)
    finally:
        out.close()
    replace(spark, waiting, path)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    return bytes(rows[0].content)


def write_json(value: dict | list, path: str, spark: SparkSession) -> None:
    write_bytes(spark, (json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1) + "\n").encode(), path)


def read_json(path: str, spark: SparkSession):
    return json.loads(read_bytes(spark, path))


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, read in the JVM; of a folder's Parquet files, that of their own in the order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha"))
    held = [r.sha for r in files.where(~F.col("path").rlike(r"/[_.][^/]*$")).orderBy("path").collect()]
    return held[0] if len(held) == 1 else hashlib.sha256("".join(held).encode()).hexdigest()


def cached(df_fingerprint: str, folder: str, seed: int, spark: SparkSession) -> bool:
    """Whether a folder holds what was prepared from inputs of this fingerprint and seed."""
    path = f"{folder}/manifest.json"
    if not exists(spark, path):
        return False
    try:
        held = read_json(path, spark)
    except ValueError:
        return False
    return held.get("inputs") == df_fingerprint and held.get("seed") == seed


def save_index(parts: dict[str, DataFrame], folder: str, meta: dict) -> None:
    """An index is its tables and what they were made with."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    write_json(meta, f"{folder}/meta.json", next(iter(parts.values())).sparkSession)


def load_index(spark: SparkSession, folder: str, names: Sequence[str]) -> tuple[dict[str, DataFrame], dict]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}, read_json(f"{folder}/meta.json", spark)


def save_embeddings(vectors: DataFrame, folder: str, model: str, dimension: int, texts: str | None = None) -> None:
    """texts: the fingerprint of what was encoded, if it is to be compared when the vectors are used again."""
    vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    spark = vectors.sparkSession
    write_json({"model": model, "dimension": dimension, "texts": texts, "fingerprint": fingerprint(spark.read.parquet(f"{folder}/vectors"))}, f"{folder}/meta.json", spark)


def load_embeddings(spark: SparkSession, folder: str, model: str | None = None, texts: str | None = None) -> DataFrame:
    """Vectors of an artifact, which must be those that it was saved with: of their number, length and fingerprint, and of the model and texts named."""
    meta = read_json(f"{folder}/meta.json", spark)
    for name, wanted in (("model", model), ("texts", texts)):
        if wanted is not None and meta[name] != wanted:
            raise SchemaError(f"made by {meta[name]}, not {wanted}")
    vectors = spark.read.parquet(f"{folder}/vectors")
    if not vectors.where(F.size("embedding") != meta["dimension"]).isEmpty():
        raise SchemaError("vectors of another length")
    if fingerprint(vectors) != meta["fingerprint"]:
        raise SchemaError("vectors aren't those that were saved")
    return vectors


def cached_embeddings(spark: SparkSession, folder: str, model: str, texts: str) -> DataFrame | None:
    """The vectors of this model and these texts, if the folder holds them whole."""
    if not exists(spark, f"{folder}/meta.json"):
        return None
    try:
        return load_embeddings(spark, folder, model, texts)
    except SchemaError:
        return None


def write_candidates(candidates: DataFrame, items: DataFrame, folder: str) -> dict:
    """Candidates that keep their contract, in order of query, rank and item, and what they are; the manifest comes last."""
    waiting = folder.rstrip("/") + ".writing"
    columns = ["query_id", "item_id", "source", "score", "rank"]
    candidates.select(*columns).repartitionByRange("query_id").sortWithinPartitions("query_id", "rank", "item_id", "source").write.mode("overwrite").parquet(f"{waiting}/rows")
    spark = candidates.sparkSession
    written = spark.read.parquet(f"{waiting}/rows")
    validate_candidates(written, items)
    manifest = written.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("queries"), F.array_sort(F.collect_set("source")).alias("sources")).first().asDict() | {"fingerprint": fingerprint(written)}
    write_json(manifest, f"{waiting}/manifest.json", spark)
    replace(spark, waiting, folder)
    return manifest


def write_predictions(ranked: DataFrame, folder: str) -> None:
    """query_id, item_id, rank and the score they were ranked by."""
    score = next(c for c in ("final_score", "score") if c in ranked.columns)
    write_sorted(ranked.select("query_id", "item_id", F.col(score).alias("score"), "rank"), folder, ["query_id", "rank"])


def feature_dictionary(df: DataFrame) -> list[dict]:
    """Each column's name and type, keys left out."""
    return [{"name": n, "dtype": t} for n, t in df.dtypes if n not in ("query_id", "item_id", "label", "fold", "split")]


def metric_rows(metrics: DataFrame, run: str, keys: Sequence[str] = ("k",)) -> DataFrame:
    """run, metric, value: one row for each number of a table of metrics, named by its keys."""
    values = [n for n, t in metrics.dtypes if n not in keys and t in ("int", "bigint", "double", "float")]
    name = F.concat_ws("@", F.lit("{}"), *(F.col(k).cast("string") for k in keys))
    each = F.array(*(F.struct(F.regexp_replace(name, r"^\{\}", v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values))
    return metrics.select(F.lit(run).alias("run"), F.explode(each).alias("m")).select("run", "m.metric", "m.value")


def answer_rows(ranked: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """query_id, answer: each query's ids in order of rank, with one space between; none is an empty text."""
    lists = ranked.where(F.col("rank") <= limit).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("l"))
    return queries.join(lists, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["item_id"]), " "), F.lit("")).alias("answer"))


def write_submission(ranked: DataFrame, queries: DataFrame, items: DataFrame, path: str, limit: int = 50, exactly: int | None = None, version: str | None = None) -> dict:
    """One CSV file of answers in the queries' order (column position), checked, then moved into place; an old one stays until then.

    version: a copy of that name and a manifest of both go beside it.
    """
    spark = queries.sparkSession
    rows = answer_rows(ranked, queries.select("query_id"), limit).join(queries.select("query_id", "position"), "query_id")
    waiting = path.rstrip("/") + ".writing"
    # a row of at most `limit` ids for each query: one file, as it is handed in
    rows.orderBy("position").select("query_id", "answer").coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(waiting)
    found = validate_submission(spark, waiting, queries, items, exactly, limit)
    fs, at = _hadoop(spark, waiting)
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    copies = [path] if version is None else [path, f"{path}.{version}"]
    for copy in copies:
        _, ready = _hadoop(spark, copy + ".ready")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, part, fs, ready, False, True, spark._jsc.hadoopConfiguration())
        replace(spark, copy + ".ready", copy)
    fs.delete(at, True)
    if version is not None:
        write_json({"version": version, "sha256": file_fingerprint(spark, path), **found}, f"{path}.{version}.json", spark)
    return found


def check_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row about a submission's bytes: files whose first line isn't exactly the header, lines with a byte order mark, and lines that aren't an id, a comma and ids."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    head = F.col("value") == "query_id,answer"
    fine = F.col("value").rlike(r'^[^,"\s]+,("[^"]*"|[^,"]*)$')
    found = lines.agg((F.count_distinct("file") - F.count_if(head)).alias("bad_headers"), F.count_if(~head & ~fine).alias("bad_lines"))
    # the reader of lines passes over a mark
    marks = spark.read.format("binaryFile").load(path).agg(F.count_if(F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf")).alias("marks"))
    return found.crossJoin(marks)


def validate_submission(spark: SparkSession, path: str, queries: DataFrame, items: DataFrame, exactly: int | None = None, at_most: int = 50) -> dict:
    """What the answers' report holds; anything wrong, answers in another order than the queries' positions among it, is an error."""
    if broken := {k: v for k, v in check_lines(spark, path).first().asDict().items() if v}:
        raise SchemaError(str(broken))
    if "position" in queries.columns:
        answers = load_answers(spark, path).withColumn("at", F.monotonically_increasing_id()).join(queries.select("query_id", "position"), "query_id")
        # rows in order of either have the same neighbours: one pass over one row a query
        if not answers.withColumn("before", F.lag("position").over(Window.partitionBy(F.lit(0)).orderBy("at"))).where("before > position").isEmpty():
            raise SchemaError("answers in another order than the queries")
    found = submission_report(load_answers(spark, path), queries.select("query_id"), items.select("item_id"), exactly, at_most).first().asDict()
    if broken := {k: v for k, v in found.items() if k != "answers" and v}:
        raise SchemaError(str(broken))
    return found
