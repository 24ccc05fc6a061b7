import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import rows
from lodestone.llm import ann, quality_classifier, quality_rules, queries, sql, url_filter
from lodestone.llm.common import stage_path


def brute(data, k, asked):
    out = []
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], float)
    for q in asked:
        s = x @ x[list(ids).index(q)]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:k]
        out.append((q, [(int(ids[j]), float(s[j])) for j in order]))
    return out


def recall(spark, data, k=20):
    got = {}
    for r in ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=k).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q, want in brute(data, k, [i for i, _ in data if i % 20 == 0]):
        mine = sorted(got.get(q, []))
        assert [r for r, *_ in mine] == list(range(1, len(want) + 1)) and len({i for _, i, _ in mine}) == len(mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for i, _ in want})
        total += len(want)
    return hit / max(total, 1)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    assert recall(spark, [(r.vec_id, [float(x) for x in r.embedding]) for r in e]) >= 0.95


def test_extra_columns_that_clash(spark):
    """Columns named as the operator names its own, and one with a dot, change nothing."""
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    more = df.select("*", *(F.lit(1).alias(c) for c in ("v", "entry", "bucket", "id", "part", "kind", "query_id", "score", "meta.url")))
    assert rows(ann.nearest(more, k=5)) == rows(ann.nearest(df, k=5))


def test_other_norms(spark):
    r = np.random.default_rng(4)
    data = [(i, (r.normal(size=10) * r.uniform(0.1, 3)).tolist()) for i in range(600)]
    assert recall(spark, data) >= 0.9


def test_copies_and_hot_buckets(spark, monkeypatch):
    """A third of the vectors are one, another third lie close together; ties go to smaller ids."""
    monkeypatch.setattr(ann, "BUCKET_ROWS", 50)
    r = np.random.default_rng(6)
    near = r.normal(size=16)
    data = [(i, [10.0] + [0.0] * 15) for i in range(150)] + [(i, (near + r.normal(size=16) * 0.01).tolist()) for i in range(150, 300)] + [(i, r.normal(size=16).tolist()) for i in range(300, 450)]
    assert recall(spark, data) >= 0.95
    out = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>")).where("query_id = 100").orderBy("rank").collect()
    assert [x.vec_id for x in out] == list(range(20)) and {x.score for x in out} == {100.0}


def test_what_takes_no_part(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (7, [float("inf"), 0.0]), (20, [0.0, 1.0])]
    out = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert rows(out, "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_urls(spark):
    cases = [
        (1, "https://www.Casino-Win.Example.com/en/1.html", "www.casino-win.example.com", "/en/1.html", None, "block"),
        (2, "http://free-bets.example.com/en/2?casino=1", "free-bets.example.com", "/en/2", None, "block"),
        (3, "http://free.example.com/en/", "free.example.com", "/en/", None, "allow"),
        (4, "http://x.example.net/en/casino", "x.example.net", "/en/casino", "example.net/en/", "allow"),
        (5, "http://example.net", "example.net", "", None, "allow"),
        (6, "http://example.net/", "example.net", "/", "net/", "block"),
        (7, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (8, "http://a.example.com/de/x#y", "a.example.com", "/de/x", "example.com/de/", "block"),
        (9, None, "", "", None, "allow"),
        (10, "casino.com/x", "", "", None, "allow"),
        (11, "http://unisex.org/fr/", "unisex.org", "/fr/", "org/fr/", "allow"),
        (12, "http://essex.com/bets?", "essex.com", "/bets", None, "allow"),
        (13, "://SEX.com", "sex.com", "", None, "block"),
        (None, "", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b, *_ in cases], "page_id long, url string, host string")
    assert rows(url_filter.filter_urls(df), "page_id", "host", "path", "rule", "verdict") == sorted(((a, *r) for a, _, *r in cases), key=repr)
    assert url_filter.filter_urls(df.where("false")).count() == 0


def test_urls_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    out = queries.op9_url_filter(spark, "/root/testdata/sf0.01")
    theirs = con.sql(sql.ORACLES["op9_url_filter"]).select(", ".join(out.columns)).fetchall()
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(theirs, key=repr)


def test_pipeline(spark):
    """Each stage by itself: columns stay, decisions take effect, and good documents are kept."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect()}
    before = docs
    for number, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = stage_path(spark, "test-stage")
        step(spark, before, d).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns
        was, now = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in (before, after))
        assert set(now) <= set(was)
        if number < 3:
            assert all(now[i] == was[i] for i in now) and len(now) < len(was)
        else:
            assert set(now) == set(was) and sum(map(len, now.values())) < sum(map(len, was.values()))
        if number == 0:
            assert len(good & set(was) - set(now)) <= 0.01 * len(good)
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, d).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in before.select("doc_id").collect()}


def whole_characters(text, runs):
    """Runs of bytes shrunk to the characters that they cover whole, and the text without them."""
    raw = text.encode()
    starts = [k for k in range(len(raw)) if raw[k] & 0xC0 != 0x80] + [len(raw)]
    gone = set()
    for a, b in runs:
        gone |= {k for s, e in zip(starts[:-1], starts[1:], strict=True) if a <= s and e <= b for k in range(s, e)}
    return bytes(x for k, x in enumerate(raw) if k not in gone).decode()


def test_pipeline_run_by_brute_force(spark):
    """run() on sf0.001: what the stages keep, and each document's tokens, from brute force over all pairs and all strings."""
    from tokenizers import Tokenizer

    from lodestone.llm.tokens import fixed_path
    from test_duplicates import brute_classes

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    judged = quality_classifier.apply(docs, quality_classifier.fit(docs)).where("quality_kept").select(docs.columns)
    kept = quality_rules.keep_good(judged, spark.read.parquet(f"{d}/labels.parquet"))
    data = [(r.doc_id, r.text) for r in kept.collect()]
    first = {}
    for (i, text), label in zip(data, brute_classes(data), strict=True):
        if i == label:
            first.setdefault(label, (i, text))
    seen, texts = {}, {}
    for i, text in sorted(first.values()):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if raw[p : p + 50] in seen and seen[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
            seen.setdefault(raw[p : p + 50], i)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        texts[i] = whole_characters(text, list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    library = Tokenizer.from_file(fixed_path("byte_bpe_50k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: r.doc_tokens for r in out} == want
    pieces, places = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held, total in [(p, want[i]) for i, p in pieces.items()] + [(p, None) for p in places.values()]:
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at == total if total else at <= 1024


def test_pipeline_leaves_others_alone(spark):
    """A frame of another operator, and one found by another thread meanwhile, can be read after a whole run; what the run staged is gone."""
    from threading import Thread

    d = "/root/testdata/sf0.001"
    frame = queries.op7_nearest(spark, d)
    before = frame.count()
    found = []
    other = Thread(target=lambda: found.append(queries.op3_near_dedup(spark, d)))
    other.start()
    out = corpus_pipeline.run(spark, d)
    other.join()
    assert frame.count() == before and found[0].count() == 200
    assert out.count() > 0
    assert not corpus_pipeline._STAGE.get().folders
