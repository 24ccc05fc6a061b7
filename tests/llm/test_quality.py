import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from lodestone.llm import quality_classifier as qc
from lodestone.llm import quality_rules as qr
from lodestone.llm import queries, sql


def brute_metrics(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)


def test_metrics(spark, docs, odd, none):
    short = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "a b c a b c", "x\ny\n\nx\n x", "#$ %a", "a b c d a b c", "é\x0bé", "a  a  a  a"])], "doc_id long, text string")
    for df in (short, docs.where(F.length("text") < 3000), odd.where("doc_id <> 7"), none):
        measured = qr.metrics(df.select("doc_id", "text")).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        for r in measured:
            assert tuple(r)[2:] == brute_metrics(r.text), r.doc_id


def test_repeated_word_text(odd):
    r = qr.metrics(odd.where("doc_id = 7").select("doc_id", "text")).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (3000, 3000, True)


def test_binomial_tail(spark):
    cases = [(0, 10), (1, 300), (3, 2000), (0, 1), (9, 4000), (30, 100)]
    df = spark.createDataFrame(cases, "k long, n long")
    for (k, n), r in zip(cases, df.select(qr.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("p")).collect(), strict=True):
        exact = sum(math.comb(n, i) * 0.005**i * 0.995 ** (n - i) for i in range(k + 1))
        assert abs(r.p - (1.0 if k > n * 0.005 else exact)) < 1e-9


def test_cutoffs_hold_their_risk(spark):
    """On labels drawn anew, a chosen rule falsely rejects no more than the risk; a rule without evidence isn't chosen."""
    r = np.random.default_rng(5)
    n = 6000
    good = r.random(n) < 0.7
    symbols = np.where(good, (r.random(n) < 0.001) * 90, (r.random(n) < 0.6) * 90).astype(int)
    data = [(i, "en" if i % 20 else "rare", 100, 500, int(s), 0, 0, False) for i, s in enumerate(symbols)]
    measured = spark.createDataFrame(data, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)] + [(0, None)], "doc_id long, quality int")
    chosen = qr.select_cutoffs(measured, labels).collect()
    assert [(c.stratum, c.rule) for c in chosen] == [("en", "symbols")]
    kept = {x.doc_id for x in qr.judge(measured, qr.select_cutoffs(measured, labels)).where("kept").collect()}
    assert np.mean([i not in kept for i in range(n) if good[i]]) <= 4 * qr.RISK
    assert np.mean([i not in kept for i in range(n) if not good[i] and i % 20]) > 0.5


def test_no_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert qr.keep_good(docs, labels).columns == docs.columns
    measured = qr.metrics(docs)
    assert rows(qr.judge(measured, qr.select_cutoffs(measured, labels)).where("kept"), "doc_id") == rows(measured.where("not base_failed"), "doc_id")


def test_rules_keep_other_columns(spark, odd, none):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert qr.keep_good(odd, labels).columns == odd.columns
    assert qr.keep_good(none, labels).count() == 0


def test_rules_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    out = queries.op2_quality_rules(spark, "/root/testdata/sf0.01")
    theirs = con.sql(sql.ORACLES["op2_quality_rules"])
    assert sorted(map(tuple, out.collect())) == sorted(theirs.select(", ".join(out.columns)).fetchall())


def test_rules_run_no_python(spark):
    plan = qr.metrics(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_em_finds_the_labellers():
    """Votes drawn from known chances: the estimate comes near to them."""
    r = np.random.default_rng(1)
    n, k = 40_000, len(qc.LABELLERS)
    good = r.random(n) < 0.8
    truth = np.stack([r.uniform(0.2, 0.7, k), np.full(k, 0.998)], 1)
    up = r.random((n, k)) < np.where(good[:, None], truth[:, 1], truth[:, 0])
    vote = np.where(r.random((n, k)) < 0.2, qc.ABSTAIN, np.where(up, qc.GOOD, qc.BAD))
    pattern, count = np.unique((vote * 3 ** np.arange(k)).sum(1), return_counts=True)
    model = qc.fit_labels(pattern, count.astype(float))
    assert abs(model.good - 0.8) < 0.02 and np.abs(model.chance - truth).max() < 0.05
    assert ((model.posterior((vote * 3 ** np.arange(k)).sum(1)) > 0.5) == good).mean() > 0.97


def test_classifier_on_labels(spark):
    """Held out: no label is used in the fit."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = qc.apply(docs, qc.fit(docs)).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("quality_kept").cast("double")).alias("kept"))
    kept = {r.quality: r.kept for r in out.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_classifier_edges(odd, none):
    out = qc.apply(odd, qc.fit(odd))
    assert out.columns == [*odd.columns, "quality_score", "quality_kept"] and out.count() == odd.count()
    again = qc.apply(out, qc.fit(odd))
    assert again.columns == out.columns
    assert qc.apply(none, qc.fit(none)).count() == 0


def test_classifier_by_hand(docs):
    """Estimation document by document instead of by pattern, and the scorer on dense rows, against the operator."""
    data = docs.select("text").collect()
    texts = [r.text or "" for r in data]
    model = qc.fit(docs)
    votes = [[qc.votes(t) // 3**j % 3 for j in range(len(qc.LABELLERS))] for t in texts]
    chance, good = [[0.7, 0.999] for _ in qc.LABELLERS], 0.85
    for _ in range(300):
        soft = []
        for v in votes:
            odds = math.log(good / (1 - good))
            for (bad, fine), x in zip(chance, v, strict=True):
                odds += math.log(fine / bad) if x == qc.GOOD else math.log((1 - fine) / (1 - bad)) if x == qc.BAD else 0
            soft.append(1 / (1 + math.exp(-odds)))
        new = []
        for j in range(len(qc.LABELLERS)):
            sums = []
            for side, first in ((0, 0.7), (1, 0.999)):
                w = [(p if side else 1 - p) for p in soft]
                sums.append((sum(x for x, v in zip(w, votes, strict=True) if v[j] == qc.GOOD) + first) / (sum(x for x, v in zip(w, votes, strict=True) if v[j] != qc.ABSTAIN) + 1))
            new.append([min(max(sums[0], 0.02), qc.MOST_MISSED), min(max(sums[1], 1 - qc.MOST_FALSE_ALARMS), 1 - 1e-6)])
        moved = max(abs(a - b) for x, y in zip(new, chance, strict=True) for a, b in zip(x, y, strict=True))
        chance, good = new, min(max(sum(soft) / len(soft), 0.02), 0.98)
        if moved < 1e-7:
            break
    assert np.allclose(model.labels.chance, chance, atol=1e-6) and abs(model.labels.good - good) < 1e-6
    # the scorer: rows of weights over all slots, by products of matrices
    shapes = qc.Shapes()
    dense = np.zeros((len(texts), qc.DIMENSIONS + 1))
    dense[:, -1] = 1
    for i, t in enumerate(texts):
        slot, value = qc.features(t, shapes)
        dense[i, slot] = value
    known = np.array([model.labels.posterior(np.array([qc.votes(t)]))[0] for t in texts])
    ahead = before = np.zeros(qc.DIMENSIONS + 1)
    for t in range(300):
        off = 1 / (1 + np.exp(-dense @ ahead)) - known
        w = ahead - 2 * (off @ dense / len(texts) + 1e-5 * ahead)
        ahead, before = w + t / (t + 3) * (w - before), w
    mine = 1 / (1 + np.exp(-dense @ w))
    got = [r.quality_score for r in qc.apply(docs, model).select("quality_score").collect()]
    assert np.allclose(sorted(got), sorted(mine), atol=1e-3)


def test_variety_is_that_of_the_poorest_window():
    rich = [f"w{k}" for k in range(400)]
    at = qc.LABELLERS.index("variety")
    vote = lambda words: qc.votes(" ".join(words)) // 3**at % 3
    assert vote(rich) == vote(rich * 3) == qc.GOOD
    assert vote([*rich, *(f"x{k % 10}" for k in range(400))]) == qc.BAD
    assert vote([*rich, *(f"x{k % 10}" for k in range(390))]) == qc.BAD


def test_one_id_trains_row_by_row(spark, docs):
    one = docs.withColumn("doc_id", F.lit(None).cast("long"))
    a, b = qc.fit(one), qc.fit(docs)
    assert np.allclose(a.weights, b.weights, atol=1e-5) and a.weights.any()
    few = qc.fit(docs, training_documents=50)
    assert few.weights.any()
