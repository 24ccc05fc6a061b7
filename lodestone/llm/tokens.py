"""Encoding texts with the byte-level vocabularies of public tokenizers.

library_encoder gives the ids of the tokenizers library. PieceCache serves encoders that merge in Python: it keeps the
ids of the pieces that a worker has met.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable

import numpy as np

from lodestone.llm.common import per_worker

#: A cache has two generations of at most so many pieces; longer pieces than CACHED_CHARS aren't kept.
CACHE_ENTRIES, CACHED_CHARS = 300_000, 64

#: White space but the space and the line end, as str.isspace() has it.
_OTHER_BLANKS = [chr(c) for c in (9, *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ASCII_BLANKS = [c for c in _OTHER_BLANKS if c.isascii()]
_DOUBLED = ("  ", " \n", "\n ", "\n\n")


def fixed_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pieces(text: str) -> list[str] | None:
    """The text cut before each space and line end, pieces but the first without the space (a line end stays).

    The pattern that splits a text before the merges never joins a blank to what stands before it, so pieces can be
    encoded by themselves. None if blanks follow one another, or there are others: such a text must stay whole.
    """
    if not text or text[0] in " \n" or text[-1] in " \n":
        return None
    for blank in _ASCII_BLANKS if text.isascii() else _OTHER_BLANKS:
        if blank in text:
            return None
    for pair in _DOUBLED:
        if pair in text:
            return None
    return text.replace("\n", " \n").split(" ")


class PieceCache:
    """ids of texts as bytes. new: ids of pieces, each with the blank before it; whole: ids of texts that can't be cut."""

    def __init__(self, new: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self.new, self.whole, self.entries = new, whole, entries
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.entries:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        cut = [pieces(t) for t in texts]
        firsts = [c.pop(0) for c in cut if c is not None]
        met = [None if c is None else list(map(cache.get, c)) for c in cut]
        gaps: list[tuple[list, int, str]] = []
        for c, m in zip(cut, met, strict=True):
            if m and None in m:
                at = -1
                for _ in range(m.count(None)):
                    at = m.index(None, at + 1)
                    gaps.append((m, at, c[at]))
        missing = {w for _, _, w in gaps}
        cache.update((w, older[w]) for w in missing if w in older)
        words = list(missing.difference(cache))
        if words:
            cache.update(zip(words, self.new([w if w[0] == "\n" else " " + w for w in words]), strict=True))
        for m, at, w in gaps:
            m[at] = cache[w]
        first, rest = iter(self.whole(firsts)), iter(self.whole([t for t, c in zip(texts, cut, strict=True) if c is None]))
        out = [next(rest) if m is None else next(first) + b"".join(m) for m in met]
        for w in words:
            if len(w) > CACHED_CHARS:
                del cache[w]
        return out


def signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary file: itself if it prints, else the next unused one."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Library:
    """ids of the tokenizers library without added special tokens, as little-endian unsigned 32-bit bytes.

    Special strings inside a text become their ids, the library's default. The library needs more than twice the time
    of tiktoken for the same merges, so texts of Latin, Greek and Cyrillic letters without special strings go through
    tiktoken, with the vocabulary of the library's own file; the library itself encodes all others, on whose characters
    the two might differ by their version of Unicode. Tests hold both against one another.
    """

    SAFE = "\u0530"

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = signs()
        ranks = {bytes(map(to_byte.__getitem__, token)): i for token, i in model["vocab"].items() if token not in self.special}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("the vocabulary's ids aren't in the order of its merges")
        self.fast = tiktoken.Encoding("file", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def one(self, text: str) -> bytes:
        if (text.isascii() or max(text) < self.SAFE) and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()
            except Exception:  # a run of blanks over the pattern engine's limit
                return self.whole([text])[0]
        return self.whole([text])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(map(self.one, texts))


def library_encoder(file: str) -> Library:
    """One for each worker and file."""
    return per_worker(("library", file), lambda: Library(file))
