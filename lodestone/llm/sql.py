"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lodestone.llm import url_filter
from lodestone.llm.quality_rules import DELTA, MAX_REPEAT_PERCENT, MIN_WORDS, RISK, RULES

ORACLES: dict[str, str] = {}

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_MEASURES = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeat_words": "n_repeat_words", "long_words": "word_chars"}
_TESTS = " UNION ALL ".join(f"SELECT '{rule}' AS rule, {j} AS step, {c}::DOUBLE AS cutoff" for rule, cuts in RULES for j, c in enumerate(cuts))
_MEASURE = "CASE rule " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE / greatest(n_words, 1)" for k, v in _MEASURES.items()) + " END"

ORACLES["op2_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '{_WORD}') AS words FROM d),
grams AS (SELECT k, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM grams) WHERE n > 1),
covered AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + j AS at FROM twice, (VALUES (0), (1), (2)) AS v(j)) GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY k),
m AS (SELECT d.k, doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (k) LEFT JOIN covered ON covered.k = d.k LEFT JOIN lines ON lines.k = d.k),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
tests AS ({_TESTS}),
counted AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND {_MEASURE} > cutoff) AS k, count(*) FILTER (quality = 0 AND {_MEASURE} > cutoff) AS bad
            FROM b JOIN q USING (doc_id) CROSS JOIN tests WHERE NOT base_failed GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k > n * {RISK} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) FROM range(0, k + 1) AS r(i)) END AS p FROM counted),
fallen AS (SELECT *, min(CASE WHEN p > {DELTA} / ((SELECT count(DISTINCT stratum) FROM counted) * {len(RULES)}) THEN step END) OVER (PARTITION BY stratum, rule) AS fall FROM tail),
best AS (SELECT stratum, rule, cutoff FROM fallen WHERE step < coalesce(fall, 1000) AND bad > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad DESC, step) = 1),
hits AS (SELECT DISTINCT b.k FROM b JOIN best USING (stratum) WHERE {_MEASURE} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND hits.k IS NULL AS kept
FROM b LEFT JOIN hits ON hits.k = b.k
"""

_A_Z = ", ".join(["'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"])
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
_TERMS = ", ".join(f"('{k}', '{t}')" for k, terms in (("strict", url_filter.STRICT), ("soft", url_filter.SOFT)) for t in terms)

ORACLES["op9_url_filter"] = rf"""
WITH r AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_A_Z}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, h, s) AS (VALUES {_RULES}),
fit AS (SELECT k, h || s AS rule, verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(h || s) DESC, h || s DESC) = 1),
terms(kind, term) AS (VALUES {_TERMS}),
found AS (SELECT k, count(*) FILTER (kind = 'strict') AS n_strict, count(*) FILTER (kind = 'soft') AS n_soft
          FROM p JOIN terms ON regexp_matches(translate(host || path, {_A_Z}), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(n_strict, 0) >= 1 OR coalesce(n_soft, 0) >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft
FROM p LEFT JOIN fit ON fit.k = p.k LEFT JOIN found ON found.k = p.k
"""

ORACLES["op10_repeats"] = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT k, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT k, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT k, p, doc_id > min(doc_id) OVER (PARTITION BY s) AS gone FROM w),
g AS (SELECT k, p, p - coalesce(lag(p) OVER (PARTITION BY k ORDER BY p), -1000) > 50 AS new FROM f WHERE gone),
r AS (SELECT k, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS span FROM g),
spans AS (SELECT k, span, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY k, span),
cuts AS (SELECT k, a, b, lag(b, 1, 0) OVER (PARTITION BY k ORDER BY a) AS before FROM spans),
kept AS (SELECT d.k, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS last, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS gone FROM d JOIN cuts USING (k) GROUP BY d.k)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN kept USING (k)
"""
