"""Text expressions: normalisation, tokens, n-grams, numbers. All but NFKC stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's \\w and \\s, which know all scripts; Java's don't without a flag.
WORD, SPACE = r"[\p{L}\p{N}_]+", r"(?U)\s+"
#: Units that may follow a number. Fixed values.
UNITS = ("кг", "г", "см", "мм", "м", "л", "мл", "вт", "квм", "кв", "гб", "mb", "gb", "tb", "тб", "год", "года", "годы", "лет", "ч", "час", "часа", "часов")
#: Units of one meaning. Fixed values.
UNIT_ALIASES = (("гб", "gb"), ("тб", "tb"), ("мб", "mb"))


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no function for it."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def collapse(c: Column | str) -> Column:
    """White space runs become one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(_text(c), SPACE, " "))


def normalize(c: Column | str, *, replace_yo: bool = True, max_chars: int | None = None, compatibility: bool = True) -> Column:
    """NFKC, lower case, ё as е, collapsed, cut to max_chars. compatibility=False: without NFKC, for texts known to be in it."""
    out = F.lower(nfkc(_text(c)) if compatibility else _text(c))
    if replace_yo:
        out = F.replace(out, F.lit("ё"), F.lit("е"))
    out = collapse(out)
    return out if max_chars is None else F.rtrim(F.substring(out, 1, max_chars))


def tokens(c: Column | str, min_length: int = 1) -> Column:
    found = F.regexp_extract_all(_text(c), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda x: F.length(x) >= min_length) if min_length > 1 else found


def lemmatized(words: Column, lemmatizer: Callable[[Column], Column] | None = None) -> Column:
    """Tokens through a lemmatiser on columns; without one they stay."""
    return words if lemmatizer is None else F.transform(words, lemmatizer)


def representations(c: Column | str, max_chars: int | None = None) -> Column:
    """raw, normalized, tokens, was_missing, was_truncated in one struct."""
    full = normalize(c)
    short = normalize(c, max_chars=max_chars)
    raw = F.col(c) if isinstance(c, str) else c
    return F.struct(raw.alias("raw"), short.alias("normalized"), tokens(short).alias("tokens"), raw.isNull().alias("was_missing"), (full != short).alias("was_truncated"))


def compose(*parts: Column | str, separator: str = " ") -> Column:
    """Non-empty parts with a separator between them."""
    return F.concat_ws(separator, *(F.nullif(_text(p), F.lit("")) for p in parts))


def compose_collapsed(*parts: Column | str) -> Column:
    """All parts with a space between them, then collapsed."""
    return collapse(F.concat_ws(" ", *(_text(p) for p in parts)))


def word_ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """Runs of low to high words, with a space between them."""

    def runs(w: Column, n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return w if n == 1 else F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    # the words are bound once: they may hold what a function of a function can't
    return F.transform(F.array(words), lambda w: F.concat(*(runs(w, n) for n in range(low, high + 1))))[0]


def char_wb_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside the words of a text, each word between two spaces; a word as short as n is one n-gram, the last."""
    padded = F.transform(F.filter(F.split(c, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.length(w)))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(padded, grams))


def canonical_numbers(c: Column | str) -> Column:
    """Distinct numbers of the normalised text, comma as point, with the unit that follows them or one blank, of one name for each meaning.

    A number and its unit stand apart from letters, digits and underscores on both sides.
    """
    word = r"[\p{L}\p{N}_]"
    pattern = rf"(?<!{word})\p{{Nd}}+(?:[.,]\p{{Nd}}+)?(?:\s?(?:" + "|".join(UNITS) + rf"))?(?!{word})"

    def canonical(x: Column) -> Column:
        out = F.regexp_replace(F.replace(x, F.lit(","), F.lit(".")), r"\s+", "")
        for old, new in UNIT_ALIASES:
            out = F.regexp_replace(out, old + "$", new)
        return out

    return F.array_distinct(F.transform(F.regexp_extract_all(normalize(c), F.lit(pattern), F.lit(0)), canonical))


def token_set(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.replace(F.lower(_text(c)), F.lit("ё"), F.lit("е")), F.lit("[0-9a-zа-я]+"), F.lit(0)))


def token_recall(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has; null without any."""
    return F.try_divide(F.size(F.array_intersect(query, text)), F.size(query))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
