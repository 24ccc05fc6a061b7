"""Operator 9, URL filters: host and path rules first, else a weighted vocabulary.

One Aho-Corasick automaton finds all terms of the vocabulary in a URL's lower-cased host and path. A hit counts only
between boundaries, where the neighbouring character is no letter or digit. One strict term, or SOFT_LIMIT distinct
soft terms, block the page. Rules name a host and a path prefix; they fit the host and its subdomains, and the longest
that fits decides alone.

Defined results: a null url, or one without "://", has an empty host and path, no rule and no hit, and is allowed.
Repeated rows are judged each by itself; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_worker

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
STRICT = ("adult", "casino", "escort", "gambling", "hentai", "malware", "nude", "phishing", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "crack", "deal", "deals", "farm", "free", "hot", "loan", "loans", "pills", "prize", "slots", "torrent", "track", "tracker", "win", "winner", "x")
SOFT_LIMIT = 2
SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>"

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            break
    else:
        return rest.translate(_LOWER), ""
    tail = rest[i:]
    ends = [k for k in (tail.find("?"), tail.find("#")) if k >= 0]
    return rest[:i].translate(_LOWER), tail[: min(ends, default=len(tail))]


def rule_for(host: str, path: str, rules: tuple = RULES) -> tuple[str, str, str] | None:
    """The longest rule that fits."""
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2]), default=None)


class Vocabulary:
    def __init__(self, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, terms in (("strict", strict), ("soft", soft)):
            for term in terms:
                self.automaton.add_word(term, (kind, term))
        self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[list[str], list[str]]:
        """Distinct strict and soft terms that stand between boundaries, sorted."""
        found: dict[str, set[str]] = {"strict": set(), "soft": set()}
        for end, (kind, term) in self.automaton.iter(text):
            begin = end - len(term)
            if (begin < 0 or text[begin] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found[kind].add(term)
        return sorted(found["strict"]), sorted(found["soft"])


def filter_urls(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: tuple = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """SCHEMA, one row for each page. A map without a shuffle; only the id and the url are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = per_worker(("urls", strict, soft), lambda: Vocabulary(strict, soft))
        for batch in batches:
            rows = []
            for page_id, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = parts(url)
                rule = rule_for(host, path, rules)
                hard, mild = vocabulary.hits(host + path.translate(_LOWER))
                verdict = rule[0] if rule else "block" if hard or len(mild) >= soft_limit else "allow"
                rows.append((page_id, host, path, rule and rule[1] + rule[2], verdict, hard, mild))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, SCHEMA)
