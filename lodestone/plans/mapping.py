"""The relations that queries run on, from the driver's tables: as DataFrames, and as SQL of the same rows.

items are parts, queries are the distinct names and types of parts, interactions are order lines, candidates are the
parts of each supplier by returned quantity under three sources, and truth are its parts at a high discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL = {
    "items": """SELECT lpad(CAST(p_partkey AS VARCHAR), 16, '0') AS item_id, p_name AS title, lower(p_type) AS params, p_name || ' ' || lower(p_type) || ' ' || CAST(p_size AS VARCHAR) || ' cm' AS text,
 CAST(p_size % 5 AS BIGINT) AS category, p_brand AS microcat, p_partkey % 25 AS location, (p_partkey % 25) * 5.0::DOUBLE - 60 AS lat, (p_partkey % 25 % 5) * 60.0::DOUBLE - 120 AS lon, p_partkey AS position FROM part""",
    "queries": """SELECT substr(sha256(p_name || '|' || p_type), 1, 16) AS query_id, p_name || ' ' || lower(p_type) AS text, p_name AS title, lower(p_type) AS params, CAST(min(p_size) % 5 AS BIGINT) AS category, min(p_partkey) % 25 AS location,
 min(p_brand) AS microcat FROM part GROUP BY p_name, p_type""",
    "train": """SELECT p_name AS search_query, CAST(c_nationkey AS BIGINT) AS search_location_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS search_is_delivery_search, lower(c_mktsegment) AS search_infm_params_text, CAST(p_size % 5 AS BIGINT) AS search_category,
 lpad(CAST(l_partkey AS VARCHAR), 16, '0') AS item_id, p_brand AS microcat, l_quantity AS quantity, l_extendedprice AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey""",
    "interactions": """SELECT sha256('data-contract-v1' || chr(30) || 'search_query=' || coalesce(search_query, '<NULL>') || chr(31) || 'search_location_id=' || coalesce(CAST(search_location_id AS VARCHAR), '<NULL>') || chr(31) || 'search_is_delivery_search=' || coalesce(CAST(search_is_delivery_search AS VARCHAR), '<NULL>') || chr(31)
 || 'search_infm_params_text=' || coalesce(search_infm_params_text, '<NULL>') || chr(31) || 'search_category=' || coalesce(CAST(search_category AS VARCHAR), '<NULL>')) AS query_id, * FROM train""",
    "scored": """SELECT lpad(CAST(l_suppkey AS VARCHAR), 16, '0') AS query_id, lpad(CAST(l_partkey AS VARCHAR), 16, '0') AS item_id, l_returnflag AS source, round(sum(l_quantity), 9) AS score FROM lineitem GROUP BY ALL""",
    "candidates": """SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item_id) AS rank FROM scored QUALIFY rank <= 50""",
    "truth": """SELECT DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 16, '0') AS query_id, lpad(CAST(l_partkey AS VARCHAR), 16, '0') AS item_id FROM lineitem WHERE l_discount >= 0.09""",
    "suppliers": """SELECT lpad(CAST(s_suppkey AS VARCHAR), 16, '0') AS query_id, CAST(s_nationkey AS BIGINT) AS location, CAST(s_suppkey % 5 AS BIGINT) AS category, s_suppkey % 3 = 0 AS is_seen, s_suppkey AS position FROM supplier""",
    "history": """SELECT search_query || ' ' || search_infm_params_text AS query, microcat AS category FROM train""",
}
_NEEDS = {"interactions": ("train",), "candidates": ("scored",), "history": ("train",)}


def sql(body: str, *names: str) -> str:
    """WITH the relations named (and those they need), then `body`, which may go on with ', more AS (...) SELECT'."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def padded(c: str):
    return F.lpad(F.col(c).cast("string"), 16, "0")


def items(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    place = F.col("p_partkey") % 25
    return p.select(padded("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.lower("p_type").alias("params"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.col("p_size").cast("string"), F.lit("cm")).alias("text"),
                    (F.col("p_size") % 5).cast("long").alias("category"), F.col("p_brand").alias("microcat"), place.alias("location"), (place * 5.0 - 60).alias("lat"), (place % 5 * 60.0 - 120).alias("lon"), F.col("p_partkey").alias("position"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.min("p_size").alias("s"), F.min("p_partkey").alias("k"), F.min("p_brand").alias("microcat"))
    return g.select(F.substring(F.sha2(F.concat_ws("|", "p_name", "p_type"), 256), 1, 16).alias("query_id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"), F.col("p_name").alias("title"), F.lower("p_type").alias("params"),
                    (F.col("s") % 5).cast("long").alias("category"), (F.col("k") % 25).alias("location"), "microcat")


def train(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    joined = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(F.col("p_name").alias("search_query"), F.col("c_nationkey").cast("long").alias("search_location_id"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("search_is_delivery_search"), F.lower("c_mktsegment").alias("search_infm_params_text"), (F.col("p_size") % 5).cast("long").alias("search_category"),
                         padded("l_partkey").alias("item_id"), F.col("p_brand").alias("microcat"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


CONTEXT = ("search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.functions.ids import context_id

    return train(spark, d).withColumn("query_id", context_id(CONTEXT))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(padded("l_suppkey").alias("query_id"), padded("l_partkey").alias("item_id"), F.col("l_returnflag").alias("source")).agg(F.round(F.sum("l_quantity"), 9).alias("score"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "item_id")
    return scored(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 50")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where("l_discount >= 0.09").select(padded("l_suppkey").alias("query_id"), padded("l_partkey").alias("item_id")).distinct()


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(padded("s_suppkey").alias("query_id"), F.col("s_nationkey").cast("long").alias("location"), (F.col("s_suppkey") % 5).cast("long").alias("category"), (F.col("s_suppkey") % 3 == 0).alias("is_seen"), F.col("s_suppkey").alias("position"))


def history(spark: SparkSession, d: str) -> DataFrame:
    return train(spark, d).select(F.concat_ws(" ", "search_query", "search_infm_params_text").alias("query"), F.col("microcat").alias("category"))
