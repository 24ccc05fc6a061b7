"""BM25, TF-IDF and number matching: parts as items, their distinct names and types as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import lexical
from lodestone.plans import mapping as m
from lodestone.plans.registry import query
from lodestone.plans.text_queries import _NORM, CHAR_WB, MARKED_SQL, NUMBERS_SQL, marked

K = 10
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)"
_WORDS = r"(SELECT {key} {keep}, unnest(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+')) AS term FROM {source})"
_WORD12 = r"(SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT {key}, list_filter(regexp_extract_all({norm}, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2) AS w FROM {source}))"


def words(key, text, source, keep=""):
    return _WORDS.format(key=key, text=text, source=source, keep=keep)


def word12(key, text, source):
    return _WORD12.format(key=key, norm=_NORM.format(text), source=source)


def char_wb(key, text, source):
    return CHAR_WB.format(key=key, norm=_NORM.format(text), source=source)


def tfidf_sql(item_terms, query_terms, n="items", min_df=1, where=""):
    """CTEs up to `hits`: query_id, item_id, score over 0."""
    return f""", it AS (SELECT item_id, term, count(*) AS tf FROM {item_terms} GROUP BY ALL), idf AS (SELECT term, ln((1 + (SELECT count(*) FROM {n})) / (1 + count(*))) + 1 AS idf FROM it GROUP BY term HAVING count(*) >= {min_df}),
 iw AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM it JOIN idf USING (term)), inorm AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM iw GROUP BY item_id), qt AS (SELECT query_id, term, count(*) AS tf FROM {query_terms} GROUP BY ALL),
 qw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qt JOIN idf USING (term)), qnorm AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
 hits AS (SELECT query_id, item_id, round(sum((qw.w / qnorm.n) * (iw.w / inorm.n)), 9) AS score FROM qw JOIN qnorm USING (query_id) JOIN iw USING (term) JOIN inorm USING (item_id) {where} GROUP BY query_id, item_id HAVING round(sum((qw.w / qnorm.n) * (iw.w / inorm.n)), 9) > 0)"""


def padded_sql(asked="queries", k=K):
    """CTE `ranked`: hits filled with zero scores by id."""
    return f""", pads AS (SELECT q.query_id, i.item_id, 0.0 AS score, 1 AS b FROM {asked} q CROSS JOIN (SELECT item_id FROM items ORDER BY item_id LIMIT {2 * k}) i WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id AND h.item_id = i.item_id)),
 best AS (SELECT *, 0 AS b FROM hits QUALIFY {_TOP} <= {k}), ranked AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY b, score DESC, item_id) AS rank FROM (SELECT * FROM best UNION ALL SELECT * FROM pads) QUALIFY rank <= {k})"""


LOWER = tfidf_sql(words("item_id", "lower(title)", "items"), words("query_id", "lower(title)", "queries"))


@query("tfidf_part_topk", m.sql(LOWER + padded_sql() + " SELECT * FROM ranked", "items", "queries"))
def tfidf_part_topk(spark, d):
    """The flagship: top parts by TF-IDF for every distinct name and type."""
    return lexical.tfidf(m.items(spark, d), m.queries(spark, d), K, text="title")


@query("tfidf_zero_padding", m.sql(", asked AS (SELECT query_id, 'zzz ' || title AS title FROM queries UNION ALL SELECT 'empty', '')" + tfidf_sql(words("item_id", "lower(title)", "items"), words("query_id", "lower(title)", "asked")) + padded_sql("asked", 300) + " SELECT * FROM ranked", "items", "queries"))
def tfidf_zero_padding(spark, d):
    q = m.queries(spark, d).select("query_id", F.concat(F.lit("zzz "), "title").alias("title"))
    return lexical.tfidf(m.items(spark, d), q.unionByName(spark.createDataFrame([("empty", "")], "query_id string, title string")), 300, text="title")


def _bm25(by="", on="", k1=1.5, b=0.75):
    part = f"PARTITION BY {by}" if by else ""
    group = f"{by}, " if by else ""
    return f""", it AS (SELECT item_id, {group}term, count(*) AS tf FROM {words("item_id", "text", "items", f", {by}" if by else "")} GROUP BY ALL), dl AS (SELECT item_id, {group}len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS dl FROM items),
 tot AS (SELECT {group}count(*) AS n, avg(dl) AS avgdl FROM dl {f"GROUP BY {by}" if by else ""}), df AS (SELECT {group}term, count(*) AS df FROM it GROUP BY ALL),
 iw AS (SELECT it.item_id, {f"it.{by}, " if by else ""}it.term, greatest(0.0, ln((n - df + 0.5) / (df + 0.5))) * tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) AS w FROM it JOIN df USING ({group}term) JOIN dl USING (item_id) JOIN tot {f"ON tot.{by} = it.{by}" if by else "ON true"}),
 qt AS (SELECT query_id, {group}term, count(*) AS tf FROM {words("query_id", "text", "asked", f", {by}" if by else "")} GROUP BY ALL),
 hits AS (SELECT query_id, item_id, round(sum(tf * w), 9) AS score FROM qt JOIN iw USING ({group}term) GROUP BY query_id, item_id HAVING round(sum(tf * w), 9) > 0)"""


@query("bm25_global", m.sql(", asked AS (SELECT * FROM queries)" + _bm25() + padded_sql("asked") + " SELECT * FROM ranked", "items", "queries"))
def bm25_global(spark, d):
    return lexical.bm25(m.items(spark, d), m.queries(spark, d), K)


_PAD_CATEGORY = f""", sup AS (SELECT category, item_id FROM items QUALIFY row_number() OVER (PARTITION BY category ORDER BY item_id) <= {2 * K}), pads AS (SELECT q.query_id, s.item_id, 0.0 AS score, 1 AS b FROM asked q JOIN sup s ON s.category = q.category WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id AND h.item_id = s.item_id)),
 best AS (SELECT *, 0 AS b FROM hits QUALIFY {_TOP} <= {K}), ranked AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY b, score DESC, item_id) AS rank FROM (SELECT * FROM best UNION ALL SELECT * FROM pads) QUALIFY rank <= {K})"""
_ODD = "CASE WHEN location % 7 = 0 THEN 99 ELSE category END"


def _odd(spark, d):
    """Some queries of a category that no item has."""
    return m.queries(spark, d).withColumn("category", F.when(F.col("location") % 7 == 0, F.lit(99).cast("long")).otherwise(F.col("category")))


_HARD = f", asked AS (SELECT query_id, text, {_ODD} AS category FROM queries WHERE {_ODD} <> 99)" + _bm25("category") + _PAD_CATEGORY


@query("bm25_category_hard", m.sql(_HARD + " SELECT * FROM ranked", "items", "queries"))
def bm25_category_hard(spark, d):
    return lexical.bm25_by_category(m.items(spark, d), _odd(spark, d), K, "hard")


_ALL = ", asked_g AS (SELECT query_id, text FROM queries WHERE " + _ODD + " = 99)" + (_bm25() + padded_sql("asked")).replace("asked", "asked_g").replace(" it AS", " it_g AS").replace("FROM it ", "FROM it_g it ").replace(", dl AS", ", dl_g AS").replace("FROM dl ", "FROM dl_g ").replace(" tot AS", " tot_g AS").replace("JOIN tot ON", "JOIN tot_g tot ON").replace(", df AS", ", df_g AS").replace("JOIN df ", "JOIN df_g df ").replace("JOIN dl ", "JOIN dl_g dl ").replace(" iw AS", " iw_g AS").replace("JOIN iw ", "JOIN iw_g iw ").replace(" qt AS", " qt_g AS").replace("FROM qt ", "FROM qt_g qt ").replace(" hits AS", " hits_g AS").replace("FROM hits", "FROM hits_g").replace(", pads AS", ", pads_g AS").replace("FROM pads", "FROM pads_g").replace(" best AS", " best_g AS").replace("FROM best", "FROM best_g").replace(" ranked AS", " ranked_g AS")


@query("bm25_category_fallback", m.sql(_HARD + _ALL + " SELECT * FROM ranked UNION ALL SELECT * FROM ranked_g", "items", "queries"))
def bm25_category_fallback(spark, d):
    return lexical.bm25_by_category(m.items(spark, d), _odd(spark, d), K, "fallback")


def _plain(item_terms, query_terms, need=("items", "queries"), extra=""):
    return m.sql(extra + tfidf_sql(item_terms, query_terms) + f" SELECT *, {_TOP} AS rank FROM hits QUALIFY rank <= {K}", *need)


@query("tfidf_word12", _plain(word12("item_id", "text", "items"), word12("query_id", "text", "queries")))
def tfidf_word12(spark, d):
    return lexical.tfidf(m.items(spark, d), m.queries(spark, d), K, lexical.word_12, pad=False)


@query("tfidf_charwb35", _plain(char_wb("item_id", "title", "items"), char_wb("query_id", "title", "queries")))
def tfidf_charwb35(spark, d):
    return lexical.tfidf(m.items(spark, d), m.queries(spark, d), K, lexical.char_wb_35, text="title", pad=False)


@query("tfidf_category", m.sql(f""", it AS (SELECT category, item_id, term, count(*) AS tf FROM {words("item_id", "lower(text)", "items", ", category")} GROUP BY ALL), idf AS (SELECT category, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM it JOIN (SELECT category, count(*) AS n FROM items GROUP BY category) USING (category) GROUP BY category, term),
 iw AS (SELECT category, item_id, term, (1 + ln(tf)) * idf AS w FROM it JOIN idf USING (category, term)), inorm AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM iw GROUP BY item_id), qt AS (SELECT category, query_id, term, count(*) AS tf FROM {words("query_id", "lower(text)", "queries", ", category")} GROUP BY ALL), asked AS (SELECT * FROM queries),
 qw AS (SELECT category, query_id, term, (1 + ln(tf)) * idf AS w FROM qt JOIN idf USING (category, term)), qnorm AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
 hits AS (SELECT query_id, item_id, round(sum((qw.w / qnorm.n) * (iw.w / inorm.n)), 9) AS score FROM qw JOIN qnorm USING (query_id) JOIN iw USING (category, term) JOIN inorm USING (item_id) GROUP BY query_id, item_id)""" + _PAD_CATEGORY + " SELECT * FROM ranked", "items", "queries"))
def tfidf_category(spark, d):
    return lexical.tfidf_by_category(m.items(spark, d), m.queries(spark, d), K)


_FIELDS = {"A": ("title", word12, "title", ""), "B": ("title || ' ' || params", char_wb, "text", ""), "C": ("text", word12, "text", ""), "D": ("params", word12, "filters", " WHERE filters <> ''")}
_ASKED = ", asked AS (SELECT query_id, text, title, CASE WHEN location % 2 = 0 THEN params ELSE '' END AS filters FROM queries)"


def _field_sql(branch):
    text, analyzer, column, where = _FIELDS[branch]
    items = f"(SELECT item_id, {text} AS x FROM items)"
    asked = f"(SELECT query_id, {column} AS x FROM asked{where})"
    return m.sql(_ASKED + tfidf_sql(analyzer("item_id", "x", items), analyzer("query_id", "x", asked)) + f" SELECT *, '{branch}' AS source, {_TOP} AS rank FROM hits QUALIFY rank <= {K}", "items", "queries")


def _fields(spark, d):
    i = m.items(spark, d).withColumnRenamed("text", "description")
    q = m.queries(spark, d).withColumn("filters", F.when(F.col("location") % 2 == 0, F.col("params")).otherwise(F.lit("")))
    return i, q


@query("field_title", _field_sql("A"))
def field_title(spark, d):
    return lexical.field_branch(*_fields(spark, d), "A", K, "title")


@query("field_title_params", _field_sql("B"))
def field_title_params(spark, d):
    return lexical.field_branch(*_fields(spark, d), "B", K, "text")


@query("field_description", _field_sql("C"))
def field_description(spark, d):
    return lexical.field_branch(*_fields(spark, d), "C", K, "text")


@query("field_params_active_only", _field_sql("D"))
def field_params_active_only(spark, d):
    return lexical.field_branch(*_fields(spark, d), "D", K, "filters")


_ROUTED = ", allowed AS (SELECT query_id, 'Brand#' || b AS route FROM queries CROSS JOIN range(1, 26) AS r(b) WHERE (b + location) % 9 = 0), ri AS (SELECT item_id, microcat AS route FROM items)" + LOWER + f""", inh AS (SELECT h.* FROM hits h JOIN ri USING (item_id) JOIN allowed a ON a.query_id = h.query_id AND a.route = ri.route QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY score DESC, h.item_id) <= <k>),
 el AS (SELECT a.query_id, ri.item_id FROM allowed a JOIN ri USING (route) QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY ri.item_id) <= <k2>),
 b1 AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY b, score DESC, item_id) AS rank FROM (SELECT *, 0 AS b FROM inh UNION ALL SELECT query_id, item_id, 0.0, 1 FROM el WHERE NOT EXISTS (SELECT 1 FROM inh WHERE inh.query_id = el.query_id AND inh.item_id = el.item_id)) QUALIFY rank <= <k>)"""


def _routed(spark, d):
    q = m.queries(spark, d)
    brands = spark.range(1, 26).withColumnRenamed("id", "b")
    allowed = q.crossJoin(F.broadcast(brands)).where((F.col("b") + F.col("location")) % 9 == 0).select("query_id", F.concat(F.lit("Brand#"), "b").alias("route"))
    return m.items(spark, d).withColumn("route", F.col("microcat")), q, allowed


@query("tfidf_routed", m.sql(_ROUTED.replace("<k>", "40").replace("<k2>", "80") + " SELECT *, 1 AS block FROM b1", "items", "queries"))
def tfidf_routed(spark, d):
    return lexical.tfidf_routed(*_routed(spark, d), 40, text="title")


@query("tfidf_routed_fallback", m.sql(_ROUTED.replace("<k>", "20").replace("<k2>", "40") + f""", outh AS (SELECT h.* FROM hits h JOIN ri USING (item_id) WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.query_id = h.query_id AND a.route = ri.route) QUALIFY row_number() OVER (PARTITION BY h.query_id ORDER BY score DESC, h.item_id) <= 10),
 taken AS (SELECT query_id, item_id FROM b1 UNION SELECT query_id, item_id FROM outh), fp AS (SELECT q.query_id, i.item_id FROM queries q CROSS JOIN (SELECT item_id FROM items ORDER BY item_id LIMIT 60) i WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.query_id = q.query_id AND t.item_id = i.item_id)),
 b2 AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY b, score DESC, item_id) AS rank FROM (SELECT *, 0 AS b FROM outh UNION ALL SELECT *, 0.0, 1 FROM fp) QUALIFY rank <= 10), n AS (SELECT query_id, count(*) AS n FROM b1 GROUP BY query_id)
 SELECT *, 1 AS block FROM b1 UNION ALL SELECT query_id, item_id, score, rank + coalesce(n, 0), 2 FROM b2 LEFT JOIN n USING (query_id)""", "items", "queries"))
def tfidf_routed_fallback(spark, d):
    return lexical.tfidf_routed(*_routed(spark, d), 20, text="title", fallback_k=10)


def _numbers(key, source):
    return f"(SELECT {key}, unnest({NUMBERS_SQL.format(text='text')}) AS num FROM {source})"


@query("numeric_overlap", m.sql(f", held AS (SELECT item_id, {MARKED_SQL} AS text FROM items), asked AS (SELECT item_id AS query_id, text || ' 7' AS text FROM held), qn AS {_numbers('query_id', 'asked')}, n AS (SELECT query_id, count(*) AS n FROM qn GROUP BY query_id), i AS {_numbers('item_id', 'held')}, hits AS (SELECT query_id, item_id, round(count(*) / any_value(n), 9) AS score FROM qn JOIN n USING (query_id) JOIN i USING (num) GROUP BY query_id, item_id) SELECT *, {_TOP} AS rank FROM hits QUALIFY rank <= {K}", "items"))
def numeric_overlap(spark, d):
    i = marked(m.items(spark, d))
    return lexical.numeric_overlap(i, i.select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" 7")).alias("text")), K)


@query("historical_intent", m.sql(", past AS (SELECT p_type || '|' || p_brand AS past_id, lower(p_type) || ' ' || lower(p_brand) AS text FROM part GROUP BY ALL), pos AS (SELECT DISTINCT p_type || '|' || p_brand AS past_id, lpad(CAST(p_partkey AS VARCHAR), 16, '0') AS item FROM part)" + tfidf_sql("(SELECT past_id AS item_id, term FROM " + char_wb("past_id", "text", "past") + ")", char_wb("query_id", "text", "queries"), "past", 2) + f", near AS (SELECT query_id, item_id AS past_id, score, {_TOP} AS rank FROM hits QUALIFY rank <= 20), g AS (SELECT query_id, item AS item_id, round(sum(score / rank), 9) AS score FROM near JOIN pos USING (past_id) GROUP BY ALL) SELECT *, {_TOP} AS rank FROM g QUALIFY rank <= {K}", "queries"))
def historical_intent(spark, d):
    p = m.table(spark, d, "part").select(F.concat_ws("|", "p_type", "p_brand").alias("query_id"), F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")).alias("text"), m.padded("p_partkey").alias("item_id"))
    return lexical.historical_intent(p.select("query_id", "text").distinct(), p.select("query_id", "item_id"), m.queries(spark, d), K)


@query("history_replay", m.sql(f", h AS (SELECT query_id, t.item_id, count(*)::DOUBLE AS score FROM queries q JOIN train t ON t.search_query = q.title GROUP BY ALL) SELECT *, {_TOP} AS rank FROM h QUALIFY rank <= {K}", "queries", "train"))
def history_replay(spark, d):
    t = m.train(spark, d).select(F.col("search_query").alias("title"), "item_id")
    return lexical.history_replay(t, m.queries(spark, d), K, "title")


_BRANCH_SQL = " UNION ALL ".join(f"SELECT * FROM ({_field_sql(b)})" for b in "ABCD")


@query("multi_branch_union", _BRANCH_SQL)
def multi_branch_union(spark, d):
    """All four branches, by other names of theirs."""
    return lexical.multi_branch(*_fields(spark, d), K, {"query_title": "title", "branch_b": "text", "description": "text", "d": "filters"})


@query("bm25_pair_scores", m.sql(", asked AS (SELECT * FROM queries)" + _bm25() + ", pairs AS (SELECT DISTINCT q.query_id, i.item_id FROM queries q JOIN items i ON i.location = q.location) SELECT query_id, item_id, coalesce(score, 0.0) AS score FROM pairs LEFT JOIN hits USING (query_id, item_id)", "items", "queries"))
def bm25_pair_scores(spark, d):
    """BM25 of given pairs: queries and items of one location."""
    i, q = m.items(spark, d), m.queries(spark, d)
    return lexical.bm25_score(i, q, q.select("query_id", "location").join(i.select("item_id", "location"), "location"))


@query("bm25_many_queries", m.sql(", part_queries AS (SELECT item_id AS query_id, title || ' ' || params AS text FROM items), asked AS (SELECT * FROM part_queries)" + _bm25() + f" SELECT *, {_TOP} AS rank FROM hits QUALIFY rank <= {K}", "items"))
def bm25_many_queries(spark, d):
    """As many queries as items, as a validation has them: each part's own name and type."""
    i = m.items(spark, d)
    q = i.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "title", "params").alias("text"))
    return lexical.bm25_of_many(i, q, K)


@query("tfidf_max_features", m.sql(", kept AS (SELECT term FROM " + words("item_id", "lower(text)", "items") + " GROUP BY term ORDER BY count(*) DESC, term LIMIT 40)" + tfidf_sql("(SELECT * FROM " + words("item_id", "lower(text)", "items") + " WHERE term IN (SELECT term FROM kept))", "(SELECT * FROM " + words("query_id", "lower(text)", "queries") + " WHERE term IN (SELECT term FROM kept))") + f" SELECT *, {_TOP} AS rank FROM hits QUALIFY rank <= {K}", "items", "queries"))
def tfidf_max_features(spark, d):
    return lexical.tfidf(m.items(spark, d), m.queries(spark, d), K, pad=False, max_features=40)
