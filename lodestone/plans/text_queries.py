"""Scalar functions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import ids, numeric
from lodestone.functions import text as tx
from lodestone.plans import mapping as m
from lodestone.plans.registry import query

_NORM = r"trim(regexp_replace(replace(lower(coalesce({}, '')), 'ё', 'е'), '\s+', ' ', 'g'))"


@query("normalize_text", f"SELECT doc_id, {_NORM.format('text')} AS normalized, rtrim(left({_NORM.format('text')}, 64)) AS cut FROM documents")
def normalize_text(spark, d):
    return m.table(spark, d, "documents").select("doc_id", tx.normalize("text").alias("normalized"), tx.normalize("text", max_chars=64).alias("cut"))


@query("tokenize", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::BIGINT AS n_tokens, len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: length(x) >= 3))::BIGINT AS n_long, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+'), ' ') AS tokens FROM documents")
def tokenize(spark, d):
    t = tx.tokens("text")
    return m.table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(tx.tokens("text", 3)).cast("long").alias("n_long"), F.array_join(t, " ").alias("tokens"))


@query("text_representations", f"SELECT doc_id, rtrim(left({_NORM.format('text')}, 200)) AS normalized, text IS NULL AS was_missing, rtrim(left({_NORM.format('text')}, 200)) <> {_NORM.format('text')} AS was_truncated, len(regexp_extract_all(rtrim(left({_NORM.format('text')}, 200)), '[\\p{{L}}\\p{{N}}_]+'))::BIGINT AS n_tokens FROM documents")
def text_representations(spark, d):
    r = m.table(spark, d, "documents").select("doc_id", tx.representations("text", 200).alias("r"))
    return r.select("doc_id", "r.normalized", "r.was_missing", "r.was_truncated", F.size("r.tokens").cast("long").alias("n_tokens"))


@query("compose_text", m.sql(r"SELECT item_id, concat_ws(' ', nullif(title, ''), nullif(params, '')) AS composed, trim(regexp_replace(title || ' ' || '' || ' ' || params, '\s+', ' ', 'g')) AS collapsed FROM items", "items"))
def compose_text(spark, d):
    return m.items(spark, d).select("item_id", tx.compose("title", "params").alias("composed"), tx.compose_collapsed("title", F.lit(None).cast("string"), "params").alias("collapsed"))


@query("query_text_structured", m.sql("SELECT DISTINCT query_id, search_query || ' ' || search_infm_params_text || ' category_' || search_category || ' location_' || search_location_id || ' delivery_' || search_is_delivery_search AS text FROM interactions", "interactions"))
def query_text_structured(spark, d):
    parts = [tx.compose("search_query", "search_infm_params_text"), *(F.concat(F.lit(f"{n}_"), F.col(c).cast("string")) for n, c in (("category", "search_category"), ("location", "search_location_id"), ("delivery", "search_is_delivery_search")))]
    return m.interactions(spark, d).select("query_id", F.concat_ws(" ", *parts).alias("text")).distinct()


@query("router_text", m.sql("SELECT DISTINCT query_id, trim(search_query) || ' ' || trim(search_infm_params_text) || ' cat_' || search_category AS word_text, ' ' || trim(search_query) || ' ' AS char_text FROM interactions", "interactions"))
def router_text(spark, d):
    t = m.interactions(spark, d)
    return t.select("query_id", tx.compose(F.trim("search_query"), F.trim("search_infm_params_text"), F.concat(F.lit("cat_"), "search_category")).alias("word_text"), F.concat(F.lit(" "), F.trim("search_query"), F.lit(" ")).alias("char_text")).distinct()


#: What stands beside an item's text, so that units, blanks and neighbours of numbers occur.
MARKS = ("5 лет", "память 128 ГБ", "iphone12", "2,5кг 1.2.3", "100 вт x9_", "12abc 7  мл 45,5 кв.м")
MARKED_SQL = "text || ' ' || CASE position % 6 " + " ".join(f"WHEN {j} THEN '{x}'" for j, x in enumerate(MARKS)) + " END"
#: A number stands apart on both sides: as this dialect can't look around, all that isn't a word character is doubled first, so that each number has marks of its own.
NUMBERS_SQL = (
    r"list_distinct(list_transform(regexp_extract_all(regexp_replace(trim(regexp_replace(replace(lower({text}), 'ё', 'е'), '\s+', ' ', 'g')), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), "
    r"'(?:^|[^\p{{L}}\p{{N}}_])(\p{{Nd}}+(?:(?:\.\.|,,)\p{{Nd}}+)?(?:(?:  )?(?:" + "|".join(tx.UNITS) + r"))?)(?:[^\p{{L}}\p{{N}}_]|$)', 1), "
    r"lambda x: regexp_replace(regexp_replace(replace(replace(replace(x, ' ', ''), '..', '.'), ',,', '.'), 'гб$', 'gb'), 'тб$', 'tb')))")


def marked(items):
    """Items with numbers and units of all kinds in their text."""
    pick = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("position") % len(MARKS) + 1).cast("int"))
    return items.withColumn("text", F.concat_ws(" ", "text", pick))


@query("canonical_numbers", m.sql(f"SELECT item_id, array_to_string(list_sort({NUMBERS_SQL.format(text=MARKED_SQL)}), ' ') AS numbers FROM items", "items"))
def canonical_numbers(spark, d):
    return marked(m.items(spark, d)).select("item_id", F.array_join(F.array_sort(tx.canonical_numbers("text")), " ").alias("numbers"))


@query("word_ngrams", m.sql(r", t AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM items), g AS (SELECT item_id, unnest(w) AS gram FROM t UNION ALL SELECT item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t) SELECT gram, count(*) AS n FROM g GROUP BY gram", "items"))
def word_ngrams(spark, d):
    return m.items(spark, d).select(F.explode(tx.word_ngrams(tx.tokens(F.lower("text")), 1, 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


CHAR_WB = r"(SELECT {key}, substr(w, i, n) AS term FROM (SELECT {key}, ' ' || unnest(string_split({norm}, ' ')) || ' ' AS w FROM {source}) CROSS JOIN (VALUES (3), (4), (5)) AS s(n) CROSS JOIN range(1, 200) AS r(i) WHERE w <> '  ' AND i <= length(w) - n + 1)"


@query("char_wb_ngrams", m.sql(f", g AS {CHAR_WB.format(key='item_id', norm=_NORM.format('title'), source='items')} SELECT term AS gram, count(*) AS n FROM g GROUP BY term", "items"))
def char_wb_ngrams(spark, d):
    return m.items(spark, d).select(F.explode(tx.char_wb_ngrams(tx.normalize("title"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("context_id", m.sql("SELECT query_id, count(*) AS n FROM interactions GROUP BY query_id", "interactions"))
def context_id(spark, d):
    return m.interactions(spark, d).groupBy("query_id").agg(F.count("*").alias("n"))


_UNSIGNED = "CAST(concat('0x', substr(sha256({}), 1, 16)) AS UBIGINT)"


@query("hash_bucket5", m.sql(f"SELECT item_id, CAST({_UNSIGNED.format(chr(39) + '42:' + chr(39) + ' || item_id')} % 5 AS INTEGER) AS bucket, round(CAST({_UNSIGNED.format(chr(39) + '42:' + chr(39) + ' || item_id')} AS DOUBLE) / 18446744073709551616.0, 12) AS u FROM items", "items"))
def hash_bucket5(spark, d):
    key = F.concat(F.lit("42:"), "item_id")
    return m.items(spark, d).select("item_id", ids.hash_bucket(key, 5).alias("bucket"), F.round(ids.hash_uniform(key), 12).alias("u"))


@query("haversine_pairs", "WITH c AS (SELECT n_nationkey AS k, n_nationkey * 5.0::DOUBLE - 60 AS lat, n_regionkey * 60.0::DOUBLE - 120 AS lon FROM nation) SELECT a.k AS a, b.k AS b, round(2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))), 6) AS km FROM c a CROSS JOIN c b")
def haversine_pairs(spark, d):
    n = m.table(spark, d, "nation")
    one = lambda x: n.select(F.col("n_nationkey").alias(x), (F.col("n_nationkey") * 5.0 - 60).alias(f"lat_{x}"), (F.col("n_regionkey") * 60.0 - 120).alias(f"lon_{x}"))
    return one("a").crossJoin(F.broadcast(one("b"))).select("a", "b", F.round(numeric.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 6).alias("km"))


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squared, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first FROM embeddings")
def l2_normalize(spark, d):
    v = numeric.l2_normalized(F.col("embedding"))
    return m.table(spark, d, "embeddings").select("vec_id", F.round(numeric.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared"), F.round(v[0], 6).alias("first"))


@query("token_recall", m.sql(r", q AS (SELECT query_id, title AS qt, list_distinct(regexp_extract_all(lower(text), '[0-9a-zа-я]+')) AS a FROM queries), i AS (SELECT item_id, title, list_distinct(regexp_extract_all(lower(text), '[0-9a-zа-я]+')) AS b, text FROM items) SELECT query_id, item_id, round(len(list_intersect(a, b)) / len(a), 9) AS recall, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard, contains(text, qt) AS phrase FROM q JOIN i ON qt = title", "queries", "items"))
def token_recall(spark, d):
    q = m.queries(spark, d).select("query_id", F.col("title").alias("qt"), tx.token_set("text").alias("a"))
    i = m.items(spark, d).select("item_id", "title", "text", tx.token_set("text").alias("b"))
    return q.join(i, F.col("qt") == F.col("title")).select("query_id", "item_id", F.round(tx.token_recall(F.col("a"), F.col("b")), 9).alias("recall"), F.round(tx.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.contains("text", "qt").alias("phrase"))
