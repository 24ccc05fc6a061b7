import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import near_dedup as nd
from lodestone.llm import queries
from lodestone.llm import repeats as rp


def weights(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[j : j + 5]) for j in range(max(min(1, len(w)), len(w) - 4)))


def similarity(a, b):
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in every) for d in set(a) & set(b))


def brute_classes(data):
    """(id, text) rows to the class id of each."""
    sets = [weights(t) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(set(a) & set(b)) * 2 > min(len(a), len(b)) and similarity(a, b) >= 0.8):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(data))]


def check(df):
    data = [(r.doc_id, r.text) for r in df.collect()]
    out, _ = nd.groups(df)
    got = out.collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(zip([d for d, _ in data], brute_classes(data), strict=True))
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.class_id for r in got}) and all(r.doc_id == r.class_id for r in kept)


def test_documents(docs):
    check(docs)


def test_odd_documents(odd, none):
    check(odd)
    out, _ = nd.groups(none)
    assert out.count() == 0
    assert nd.keep_one(odd).columns == odd.columns


def test_chains_and_hot_groups(spark):
    """Copies of one text with a few words changed, chains of them, and one passage that many texts share."""
    r = np.random.default_rng(7)
    word = lambda: "w" + str(r.integers(0, 5000))
    base = [word() for _ in range(120)]
    data = [(i, " ".join(base)) for i in range(20)]
    for i in range(20, 60):
        t = list(base)
        for k in r.integers(0, 120, 3):
            t[k] = word()
        data.append((i, " ".join(t)))
    t = list(base)
    for i in range(60, 90):
        t = list(t)
        t[r.integers(0, 120)] = word()
        data.append((i, " ".join(t)))
    for i in range(90, 130):
        data.append((i, " ".join([*base[:60], *(word() for _ in range(60))])))
    check(spark.createDataFrame(data, "doc_id long, text string").repartition(3))


def brute_components(texts):
    """Class (smallest position) of texts whose shingles all differ within a text, by products of incidence rows."""
    sets = [set(weights(t)) for t in texts]
    assert all(max(weights(t).values()) == 1 for t in texts)
    number = {k: j for j, k in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(texts), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[k] for k in s]] = 1
    both = has @ has.T
    like = both / (has.sum(1)[:, None] + has.sum(1)[None, :] - both) >= 0.8 - 1e-6
    low = np.arange(len(texts))
    while True:
        new = np.array([low[row].min() for row in like])
        if (new == low).all():
            return low.tolist(), both / (has.sum(1)[:, None] + has.sum(1)[None, :] - both)
        low = new


def family(r, n, base, own, name):
    """n texts of one passage of `base` words and `own` words each."""
    passage = [f"{name}{k}" for k in range(base)]
    return [" ".join([*passage, *(f"{name}{i}x{k}" for k in range(own))]) for i in range(n)]


def test_families_below_the_threshold(spark, monkeypatch):
    """Hundreds of texts just below the threshold, thousands that share most bands' registers, and a few links hidden among them."""
    r = np.random.default_rng(11)
    near = family(r, 300, 104, 16, "n")
    many = family(r, 3000, 100, 30, "m")
    for i in range(40, 60):  # copies of others of the family with a word or two changed
        t = many[i].split()
        t[int(r.integers(100, 130))] = f"z{i}"
        many.append(" ".join(t))
    texts = [*near, *many]
    low, like = brute_components(texts)
    inside = like[:300, :300][~np.eye(300, dtype=bool)]
    assert 0.72 <= inside.min() and inside.max() <= 0.79
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(nd, "BLOCK", 60_000)
    sizes = []
    cells = nd.cells
    monkeypatch.setattr(nd, "cells", lambda now: sizes.append((now.groupBy("key").count().agg(F.max("count")).first()[0], cells(now).agg(F.max("j")).first()[0])) or cells(now))
    got = {x.doc_id: x.class_id for x in nd.groups(df)[0].collect()}
    assert [got[i] for i in range(len(texts))] == low
    assert sizes[0][0] > 800 and sizes[0][1] >= 2  # large keys, cut in blocks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=40), min_size=2, max_size=6))
def test_the_bound_is_one(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    held = nd.Shingled(words, np.array(list(map(len, texts)), np.int64), 2)
    most = held.at_most(0, np.arange(1, len(texts)))
    for k, bound in enumerate(most.tolist()):
        exact = held.similarity(0, k + 1)
        assert bound >= exact - 1e-9
        if all(len(set(zip(t[:-1], t[1:], strict=True))) == len(t) - 1 and len(t) > 1 for t in (texts[0], texts[k + 1])):
            assert abs(bound - exact) < 1e-9


def test_a_scope_owns_what_it_stages(spark):
    """Frames of one owner outlive the scopes of others, in this thread and in another."""
    from threading import Thread

    from lodestone.llm.common import Scope, stage

    frame = stage(spark.range(10).toDF("x"), "mine")
    fails = []

    def other():
        try:
            with Scope(spark) as scope:
                kept, gone = stage(spark.range(3).toDF("x"), "kept"), stage(spark.range(4).toDF("x"), "gone")
                scope.keep(kept)
            assert kept.count() == 3 and not exists(spark, gone) and exists(spark, kept)
        except Exception as e:  # noqa: BLE001
            fails.append(e)

    with Scope(spark) as scope:
        t = Thread(target=other)
        t.start()
        inner = stage(spark.range(5).toDF("x"), "inner")
        t.join()
        assert not fails and scope.folders == [inner._staged]
    assert not exists(spark, inner) and frame.count() == 10


def exists(spark, frame):
    path = spark._jvm.org.apache.hadoop.fs.Path(frame._staged)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_slices_are_bounded_by_words(monkeypatch):
    monkeypatch.setattr(nd, "SLICE_ROWS", 4)
    monkeypatch.setattr(nd, "SLICE_WORDS", 10)
    counts = [3, 3, 3, 3, 0, 25, 10, 1, 0, 0, 0, 0, 0, 9, 2]
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(n)) for n in counts], pa.list_(pa.int64()))], names=["words"])
    parts = [[len(w) for w in x.column("words").to_pylist()] for x in nd.slices(batch)]
    assert parts == [[3, 3, 3], [3, 0], [25], [10], [1, 0, 0, 0], [0, 0, 9], [2]]
    assert list(nd.slices(batch.slice(0, 0))) == []


def test_texts_come_in_small_batches(spark, monkeypatch):
    """Long texts reach the workers in batches of a few MB, and the caller's session keeps its own batches."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d e "), F.repeat(F.lit("word "), 600), F.col("id")).alias("text")).coalesce(1)

    def spied(name):
        real = getattr(nd, name)

        def call(table, *rest, **more):
            if "text" in table.columns or "words" in table.columns and "same" in table.columns:
                sizes = table.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches), "n long, size long")
                seen.append((name, sizes.agg(F.max("n"), F.max("size")).first()))
            return real(table, *rest, **more)

        monkeypatch.setattr(nd, name, call)

    spied("signed")
    spied("only")
    assert nd.groups(docs)[0].count() == 6000
    assert {name for name, _ in seen} == {"signed", "only"}
    assert all(n <= 1024 and size < 16 << 20 for _, (n, size) in seen)
    assert spark.conf.get(key) == before


def test_registers_estimate_the_similarity():
    r = np.random.default_rng(2)
    for shared, only in ((60, 10), (30, 30), (3, 1)):
        a = {int(x): float(r.integers(1, 4)) for x in r.integers(1, 1 << 60, shared + only)}
        b = {k: v for k, v in list(a.items())[:shared]} | {int(x): 1.0 for x in r.integers(1, 1 << 60, only)}
        doc = np.repeat([0, 1], [len(a), len(b)])
        keys = [*sorted(a), *sorted(b)]
        held = nd.signatures(doc, np.array(keys, np.uint64), np.array([a[k] for k in sorted(a)] + [b[k] for k in sorted(b)]), 2, 3000)
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        exact = nd.probability_jaccard(x, np.array([a[k] for k in sorted(a)]), y, np.array([b[k] for k in sorted(b)]))
        assert abs(exact - similarity(a, b)) < 1e-9
        assert abs((held[0] == held[1]).mean() - exact) < 0.04


def brute_removed(data, length=50):
    """Per (id, text): bytes, removed, spans, hash of the rest."""
    first = {}
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, t in data:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            f = first[b[p : p + length]]
            if i is not None and (f is None or f < i):
                gone[p : p + length] = True
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    s = rp.cut_repeats(df)
    out = s.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long"), F.size("spans").cast("long"), F.sha2("kept", 256))
    return sorted(map(tuple, out.collect()), key=repr)


def check_removed(df):
    assert removed(df) == brute_removed([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def tough(spark, seed=0, n=150):
    r = np.random.default_rng(seed)
    parts = ["".join(r.choice(list("ab"), 200)) for _ in range(4)]
    data = []
    for _ in range(n):
        t = ""
        for _ in range(r.integers(0, 6)):
            kind = r.integers(0, 4)
            if kind == 0:
                a, b = sorted(r.integers(0, 200, 2))
                t += parts[r.integers(0, 4)][a:b]
            elif kind == 1:
                t += "x" * int(r.integers(0, 120))
            elif kind == 2:
                t += "".join(r.choice(list("abc \n"), r.integers(0, 90)))
            else:
                t += "é" * int(r.integers(0, 40)) + str(r.integers(0, 5))
        data.append((int(r.integers(0, n)), t))
    return spark.createDataFrame(data, "doc_id long, text string").repartition(3)


def test_repeats_in_documents(docs, odd, none):
    check_removed(docs)
    check_removed(odd)
    assert removed(none) == []


def test_repeats_in_slices(spark, monkeypatch):
    monkeypatch.setattr(rp, "SLICE", 700)
    check_removed(tough(spark))


def test_repeats_under_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(rp, "HOT_SHARE", 0.01)
    check_removed(tough(spark, 1))


def test_the_least_id_is_kept(spark):
    df = spark.createDataFrame([(rp.NULL_ID, "a" * 60), (5, "a" * 60)], "doc_id long, text string")
    assert removed(df) == brute_removed([tuple(r) for r in df.collect()])


def test_whole_characters(spark):
    df = spark.createDataFrame([(1, "é" * 40, "m"), (2, "x" + "é" * 40 + "ü", "n")], "doc_id long, text string, meta string").withColumn("n_chars", F.length("text"))
    out = rp.without_repeats(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "é" * 40, "m", 40), (2, "xü", "n", 2)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), min_size=0, max_size=25), min_size=2, max_size=6))
def test_maximal_repeats(texts):
    """Every repeat of five bytes or more that can't be longer without losing an occurrence, with all of its occurrences."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    got = {}
    for size, text, start in rp.maximal_repeats(data, begin, end, 5):
        got[texts[text[0]][start[0] - begin[text[0]] :][:size]] = sorted(zip(text.tolist(), (start - begin[text]).tolist(), strict=True))
    places = {}
    for k, t in enumerate(texts):
        for p in range(len(t)):
            for n in range(5, len(t) - p + 1):
                places.setdefault(t[p : p + n], []).append((k, p))
    want = {}
    for s, at in places.items():
        if len(at) > 1:
            left = {texts[k][p - 1] if p else (k,) for k, p in at}
            right = {texts[k][p + len(s)] if p + len(s) < len(texts[k]) else (k,) for k, p in at}
            if len(left) > 1 and len(right) > 1:
                want[s] = sorted(at)
    assert got == want


def test_queries_have_their_columns(spark):
    d = "/root/testdata/sf0.001"
    assert queries.op10_repeats(spark, d).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert queries.op3_near_dedup(spark, d).columns == ["doc_id", "class_id", "kept"]


def test_repeats_sql(spark):
    import duckdb

    from lodestone.llm import sql

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    out = queries.op10_repeats(spark, "/root/testdata/sf0.001")
    theirs = con.sql(sql.ORACLES["op10_repeats"]).select(", ".join(out.columns)).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(theirs)
