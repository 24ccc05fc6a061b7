import hashlib
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import rows
from lodestone.llm import bpe, packing, queries, token_counts, token_files, tokens
from lodestone.llm.common import stage_path

JSON, RANKS, PIECES = (tokens.fixed_path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(JSON)
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)
FAST = tiktoken.Encoding("t", pat_str=tokens.pattern(), mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
HARD = ["", " ", "  a", "a ", "a\n\nb", "it's ''s ²x a_b", "<|endoftext|>", "a<|endoftext|> b", "日本語 テキスト", "😀😀 x", "\x1c\x85\xa0 y", " ", "ab" * 700, "#$%" * 500, "▁ ▁▁a", "<s> </s>", "\x00 a", "é́ ́x"]
WORDS = token_counts.Words(PIECES)
TEXTS = st.text(st.sampled_from(list("ab Z9'.,\n\t▁_é²日😀#")), max_size=40)


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_any_text(text):
    assert np.frombuffer(bpe.load(RANKS).encode([text])[0], "<u4").tolist() == FAST.encode_ordinary(text)
    assert np.frombuffer(tokens.library_encoder(JSON)([text])[0], "<u4").tolist() == library_ids(text)
    assert WORDS.count(text) == len(SP.encode(text))


def test_hard_texts():
    words = token_counts.Words(PIECES)
    for text in HARD:
        assert np.frombuffer(bpe.load(RANKS).encode([text])[0], "<u4").tolist() == FAST.encode_ordinary(text), text
        assert np.frombuffer(tokens.library_encoder(JSON)([text])[0], "<u4").tolist() == library_ids(text), text
        assert words.count(text) == len(SP.encode(text)), text


def test_long_matches_merge_alike():
    b = bpe.load(RANKS)
    for m in (b"ab" * 300, b"!" * 700, bytes(range(256)) * 3):
        assert b.matches([m])[0] == b.long(m)


def test_encoders_agree_on_all_documents(docs):
    fast, whole = tokens.library_encoder(JSON), tokens.library_encoder(JSON).whole
    texts = [t for _, t in texts_of(docs)]
    assert fast(texts) == whole(texts)


def test_round_trip(spark, docs, odd, none):
    for df in (docs, odd, none):
        want = sorted(((i, len(x := FAST.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts_of(df)), key=repr)
        coded = bpe.round_trip(df, RANKS)
        got = coded.select("doc_id", F.size("ids").cast("long"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256), F.sha2("decoded", 256))
        assert rows(got) == want
    assert rows(bpe.decode_ids(bpe.encode_texts(odd, RANKS), RANKS).select(F.decode("decoded", "UTF-8"))) == sorted(((t,) for _, t in texts_of(odd)), key=repr)


def test_counts(docs, odd, none):
    for df in (docs, odd, none):
        want = sorted(((i, len(t.encode()), len(SP.encode(t))) for i, t in texts_of(df)), key=repr)
        assert rows(token_counts.count_tokens(df, PIECES), "doc_id", "n_bytes", "n_tokens") == want


def test_counts_do_not_depend_on_the_table(docs):
    small = token_counts.count_tokens(docs, PIECES, table=token_counts.Table({}))
    assert rows(small) == rows(token_counts.count_tokens(docs, PIECES))


def test_packing(docs, odd, none):
    for df in (docs, odd, none):
        window = 64
        out = packing.pack_documents(df, JSON, window).collect()
        pieces, sequences = {}, {}
        for r in out:
            assert len(r.ids) == 4 * r.length
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            pieces.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids)))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == window or at & (at - 1) == 0 and at < window
        once = [(i, t) for i, t in texts_of(df) if [j for j, _ in texts_of(df)].count(i) == 1]
        for i, t in once:
            want = np.array([*library_ids(t), 0], "<u4").tobytes()
            at = 0
            for start, length, _ in sorted(pieces[i]):
                assert start == at
                at += length
            assert b"".join(x for *_, x in sorted(pieces[i])) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60))
def test_pack_loses_nothing(lengths):
    out = packing.pack(np.array(lengths, np.int64), 32)
    covered = {}
    for bin_ in out:
        n = sum(x[2] for x in bin_)
        assert n == 32 or n & (n - 1) == 0
        for item, at, length in bin_:
            covered.setdefault(item, []).append((at, length))
    for item, length in enumerate(lengths):
        at = 0
        for a, n in sorted(covered[item]):
            assert a == at
            at += n
        assert at == length


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_fill_is_the_least_slack(lengths):
    counts = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    order = sorted(counts, reverse=True)
    used = packing.fill(order, counts, 24)
    assert all(used[k] <= counts[k] for k in used) and used[order[0]] >= 1
    rest = list(lengths)
    rest.remove(order[0])
    reach = {order[0]}
    for x in rest:
        reach |= {r + x for r in reach if r + x <= 24}
    assert sum(k * n for k, n in used.items()) == max(reach)


def test_files(spark, docs, odd):
    for df in (docs, odd):
        folder = stage_path(spark, "test-files")
        manifest = token_files.write_files(df, JSON, folder, 50_257, length=128)
        assert manifest.count() >= 1
        held = sorted(texts_of(df), key=lambda x: (x[0] is not None, x[0] or 0))
        got = token_files.read_documents(spark, folder).orderBy("start").collect()
        assert [r.doc_id for r in got] == [i for i, _ in held]
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
        once = {i: t for i, t in held if [j for j, _ in held].count(i) == 1}
        for r in got:
            if r.doc_id in once:
                ids = np.array([*library_ids(once[r.doc_id]), 0], "<u4").tobytes()
                assert zlib.crc32(bytes(r.ids)) == zlib.crc32(ids)


def test_files_give_views(spark, docs):
    folder = stage_path(spark, "test-files")
    path = token_files.write_files(docs, JSON, folder, 50_257, length=128).orderBy("shard").first().path
    shard = token_files.Shard.open(*token_files.file_system("file://" + path))
    ids, mask = shard.sequence(3)
    assert len(ids) == 128 and ids.dtype == np.uint16 and not ids.flags.owndata and pa.compute.all(mask).as_py()


def test_no_documents(spark, none):
    folder = stage_path(spark, "test-files")
    assert token_files.write_files(none, JSON, folder, 50_257).count() == 0
    assert token_files.read_documents(spark, folder).count() == 0


def test_queries_have_their_columns(spark):
    for name, columns in {"op4_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op6_token_files": "doc_id start n_tokens ids_crc32", "op8_token_counts": "doc_id n_bytes n_tokens over_limit"}.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns.split()
