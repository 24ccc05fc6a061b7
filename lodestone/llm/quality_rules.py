"""Operator 2, quality rules [native]: thresholds whose risk is controlled on labelled holdouts.

Every rule rejects a document whose measure passes a cutoff. For each stratum and rule the cutoffs are walked from the
mildest to the strictest (fixed-sequence testing); a cutoff stands if the exact binomial tail P(Bin(n, risk) <= k), for
k false rejections among n good holdout documents, is at most its share of the error budget, and the walk ends at the
first that doesn't. That is the Clopper-Pearson upper bound being at most `risk`, without inverting it. The budget is
divided among all strata and rules (Bonferroni), so with chance 1 - delta no stratum loses more than
rules * risk of its good documents. Of the cutoffs that stand, the mildest that rejects the most bad documents is used.

DataFrame functions only. The metrics of a document need its own row alone; nothing but the counts of labelled
documents by stratum, rule and cutoff is shuffled.

Defined results: a null or empty text has no words and fails the base rules. A label counts once per document, the
worst of its values; documents without one aren't in a holdout. A null stratum is a stratum. Windows of three words are
compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage

#: A word is a run of anything but blanks of ASCII.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rules: a measure, and the cutoffs over which it rejects, mildest first. All measures are per word.
RULES = (
    ("symbols", (1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    ("dup_lines", (0.2, 0.15, 0.1, 0.07, 0.05, 0.035, 0.025, 0.015, 0.01, 0.005)),
    ("repeat_words", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08)),
    ("long_words", (40.0, 30.0, 24.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
)
RISK, DELTA = 0.005, 0.05


def repeat_words(words: Column) -> Column:
    """Words inside windows of three that are found twice or more in the text."""
    last = F.size(words) - F.lit(2)
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))

    def among(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.transform(F.array(ordered), lambda s: F.transform(F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))[0]

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))).cast("long")

    # bound once through a one-element transform, so that the windows are hashed once
    counted = F.transform(F.array(windows), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(among(h))))[0]
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted)


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")

    def measured(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = docs.withColumn("__w", F.transform(F.array(words), measured)[0]).withColumn("__d", F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0])
    out = out.withColumns({
        "n_words": F.col("__w.n"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.col("__d"),
        "n_repeat_words": F.col("__w.r"),
    }).drop("__w", "__d")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbols": F.col("n_symbols") / n, "dup_lines": F.col("n_dup_lines") / n, "repeat_words": F.col("n_repeat_words") / n, "long_words": F.col("word_chars") / n}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, from the ratio of neighbouring terms; k over n * p is no evidence and gives 1."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i.cast("double")) + odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long")), start, add)["total"]
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(summed)


def select_cutoffs(measured: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, false_rejections, bad_rejections) of the rules that hold, from documents with metrics."""
    label = labels.where("quality is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__q"))
    held = measured.where(~F.col("base_failed")).select(F.col(id_col).alias("__id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.struct(*(c.alias(k) for k, c in measures().items())).alias("m")).join(label, "__id")
    tests = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.lit(j).alias("step"), (F.col("m")[rule] > c).alias("hit")) for rule, cuts in RULES for j, c in enumerate(cuts)))
    counted = held.select("stratum", "__q", F.explode(tests).alias("t")).groupBy("stratum", "t.rule", "t.cutoff", "t.step").agg(
        F.count_if(F.col("__q") == 1).alias("n_good"), F.count_if((F.col("__q") == 1) & F.col("t.hit")).alias("false_rejections"), F.count_if((F.col("__q") == 0) & F.col("t.hit")).alias("bad_rejections"))
    strata = counted.select(F.count_distinct("stratum").alias("strata"))
    tested = counted.crossJoin(F.broadcast(strata)).withColumn("stands", binomial_tail(F.col("false_rejections"), F.col("n_good"), risk) <= F.lit(delta) / (F.col("strata") * len(RULES)))
    walks = tested.groupBy("stratum", "rule").agg(F.array_sort(F.collect_list(F.struct("step", "cutoff", "stands", "n_good", "false_rejections", "bad_rejections"))).alias("walk"))
    first_fall = F.coalesce(F.array_min(F.transform(F.filter("walk", lambda x: ~x["stands"]), lambda x: x["step"])), F.lit(1 << 20))
    standing = F.filter("walk", lambda x: x["step"] < F.col("fall"))
    best = F.array_max(F.transform("standing", lambda x: F.struct(x["bad_rejections"].alias("bad"), (-x["step"]).alias("mild"), x["cutoff"].alias("cutoff"), x["n_good"].alias("n_good"), x["false_rejections"].alias("false_rejections"))))
    chosen = walks.withColumn("fall", first_fall).withColumn("standing", standing).withColumn("best", best)
    return chosen.where("best.bad > 0").select("stratum", "rule", F.col("best.cutoff").alias("cutoff"), F.col("best.n_good").alias("n_good"), F.col("best.false_rejections").alias("false_rejections"), F.col("best.bad").alias("bad_rejections"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """`measured` with `kept`. Cutoffs are few: rules times strata; they come as one row for each stratum, joined by it."""
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"__c_{rule}") for rule, _ in RULES)).withColumnRenamed("stratum", "__stratum")
    joined = measured.withColumn("__s", F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))).join(wide, F.col("__s") == F.col("__stratum"), "left")
    hit = F.lit(False)
    for rule, measure in measures().items():
        hit = hit | F.coalesce(measure > F.col(f"__c_{rule}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~hit).drop("__s", "__stratum", *(f"__c_{rule}" for rule, _ in RULES))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """`docs` without those that are rejected. Texts are measured once and staged with their measures; no text is shuffled."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("lang"), F.col(text_col).alias("text"))
    measured = stage(metrics(packed).drop("text"), "measured")
    cutoffs = stage(select_cutoffs(measured, labels), "cutoffs")
    return judge(measured, cutoffs).where("kept").select("doc.*")
