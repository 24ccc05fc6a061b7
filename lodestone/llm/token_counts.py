"""Operator 8, token counts: a map-side lookup in two tiers.

No piece of the vocabulary has a word mark after another character, so the merges of the library never reach over the
start of a word, and a text's tokens are the sum of its words' tokens. The first tier is a compact table, broadcast once,
of the lengths of frequent words: their bytes in one string and one small number each. The second is the cache of
each Python worker, where the library has encoded the words that the table misses. No word is ever shuffled.

The table is fitted on at most SAMPLE_DOCUMENTS documents, chosen by the hash of their ids, and holds at most
TABLE_WORDS words (a few hundred kilobytes). It decides how fast a word is looked up, never the count.

Defined results: a null or empty text has no bytes and no tokens. Repeated rows and null ids are counted each by itself;
an empty table gives an empty result. Words longer than CACHED_CHARS are encoded each time, never cached.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hash_share, id_text, per_worker

MARK = "▁"
SAMPLE_DOCUMENTS, TABLE_WORDS = 2000, 20_000
CACHE_ENTRIES, CACHED_CHARS = 600_000, 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long"

_RUNS = re.compile(f"{MARK}+[^{MARK}]*").findall


class Words(dict):
    """Word (without its own mark) to its number of tokens. Words that it misses are encoded, and kept while there's room."""

    def __init__(self, file: str):
        import sentencepiece

        super().__init__()
        self.frequent: dict[str, int] = {}
        self.library = sentencepiece.SentencePieceProcessor(model_file=file)
        inner = [p for p in map(self.library.id_to_piece, range(self.library.get_piece_size())) if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces such as {inner[0]!r} reach over words; this vocabulary can't be counted by words")

    def __missing__(self, word: str) -> int:
        n = len(self.library.encode(word, num_threads=1))
        if len(word) <= CACHED_CHARS:
            if len(self) > CACHE_ENTRIES + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        """The tokens of a text. The library puts one word mark before it, and turns spaces into marks."""
        if not text:
            return 0
        if text[-1] == " " or "  " in text or text[0] == " " or MARK in text:
            return sum(map(self._run, _RUNS(MARK + text.replace(" ", MARK))))
        return sum(map(self.__getitem__, text.split(" ")))

    def _run(self, run: str) -> int:
        """Tokens of some marks and what follows; a lone mark isn't an empty text, which the library would give none."""
        return self[run[1:]] if len(run) > 1 else 1


class Table:
    """Frequent words and their lengths in tokens, in one string and one array."""

    def __init__(self, lengths: dict[str, int]):
        self.words, self.lengths = "\n".join(lengths), np.array(list(lengths.values()), np.uint8)

    def into(self, words: Words) -> Words:
        if self.words:
            words.frequent = dict(zip(self.words.split("\n"), self.lengths.tolist(), strict=True))
            words.update(words.frequent)
        return words


def fit_table(docs: DataFrame, file: str, sample_documents: int = SAMPLE_DOCUMENTS, table_words: int = TABLE_WORDS) -> Table:
    """docs: doc_id, text. Words are cut and counted by Spark in the sample alone."""
    share = sample_documents / max(docs.count(), 1)
    sample = docs.where(hash_share(F.col("doc_id"), share))
    counted = sample.select(F.explode(F.split("text", " ")).alias("word")).where((F.length("word") > 0) & (F.length("word") <= CACHED_CHARS) & ~F.contains("word", F.lit("\n")) & ~F.contains("word", F.lit(MARK))).groupBy("word").count()
    words = Words(file)
    return Table({r.word: n for r in counted.orderBy(F.desc("count"), "word").limit(table_words).collect() if (n := words[r.word]) < 256})


def count_tokens(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", table: Table | None = None) -> DataFrame:
    """SCHEMA, one row for each document; a map without a shuffle."""
    rows = id_text(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(table or fit_table(rows, file))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(("words", file), lambda: Words(file))
        held.value.into(words)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(list(map(words.count, texts)), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, SCHEMA)
