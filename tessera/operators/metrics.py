"""Evaluation metrics, votes, drift and statistics over runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text as T
from tessera.operators.retrieval import DIGITS


def f_beta(gold: Column, found: Column, beta: float = 2.5) -> Column:
    """F-beta of two id arrays as sets: 1 if both are empty, 0 if one is."""
    g, f = F.array_distinct(gold), F.array_distinct(found)
    hit = F.size(F.array_intersect(g, f))
    precision, recall = hit / F.size(f), hit / F.size(g)
    b = beta * beta
    score = F.when(hit == 0, 0.0).otherwise((1 + b) * precision * recall / (b * precision + recall))
    return F.when((F.size(g) == 0) & (F.size(f) == 0), 1.0).when((F.size(g) == 0) | (F.size(f) == 0), 0.0).otherwise(score)


def recall_at(gold: Column, ranked: Column, k: int) -> Column:
    """Share of the gold ids among the first k; 1 without gold ids."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(g, F.slice(ranked, 1, k))) / F.size(g)).otherwise(1.0)


def hits_and_mrr(rows: DataFrame, by: str = "qid", rank: str = "rank", label: str = "label") -> DataFrame:
    """questions, hit@1, hit@2 and mean reciprocal rank of the first positive."""
    first = rows.groupBy(by).agg(F.min(F.when(F.col(label) == 1, F.col(rank))).alias("first"))
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return first.agg(F.count(F.lit(1)).alias("questions"), F.round(at(1), DIGITS).alias("hit_1"), F.round(at(2), DIGITS).alias("hit_2"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), DIGITS).alias("mrr"))


def floor_percentile(df: DataFrame, value: str, quantile: float, by: list[str], nearest: bool = False) -> DataFrame:
    """Value at the floor (or half-even rounded) index of the sorted values.

    Exact and distributed: a count and a rank; groups aren't collected.
    """
    size = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    index = (F.col("n") - 1) * quantile
    size = size.withColumn("at", (F.bround(index) if nearest else F.floor(index)).cast("long") + 1)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    upto = counts.withColumn("upto", F.sum("m").over(Window.partitionBy(*by).orderBy(value)))
    return upto.join(size, by).where("upto >= at and upto - m < at").select(*by, F.col(value).alias("percentile"), "n")


def weighted_mean(value: Column, weight: Column) -> Column:
    total = F.sum(weight)
    return F.when(total != 0, F.sum(value * weight) / total).otherwise(0.0)


def safe_mean(value: Column) -> Column:
    """Mean; 0 for no rows."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def majority_vote(answers: DataFrame, by: str = "qid", answer: str = "answer", pos: str = "pos") -> DataFrame:
    """Most frequent answer; ties go to the first seen. Confidence is high if all
    agree, medium above half, else low. Null answers don't vote."""
    votes = answers.where(F.col(answer).isNotNull()).groupBy(by, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(pos).alias("first"))
    votes = votes.withColumn("total", F.sum("votes").over(Window.partitionBy(by)))
    votes = votes.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("votes"), "first")))
    sure = F.when(F.col("votes") == F.col("total"), "high").when(F.col("votes") * 2 > F.col("total"), "medium").otherwise("low")
    return votes.where("place = 1").select(by, answer, "votes", "total", sure.alias("confidence"))


def run_diff(a: DataFrame, b: DataFrame, key: str, answer: str, pages: str) -> DataFrame:
    """Differences of two runs; ``status`` tells rows that only one of them has."""
    x, y = a.select(key, F.col(answer).alias("answer_a"), F.col(pages).alias("pages_a")), b.select(F.col(key).alias("key_b"), F.col(answer).alias("answer_b"), F.col(pages).alias("pages_b"))
    both = x.join(y, F.col(key) == F.col("key_b"), "full_outer")
    status = F.when(F.col("key_b").isNull(), "only_a").when(F.col(key).isNull(), "only_b").otherwise("both")
    return both.select(F.coalesce(key, "key_b").alias(key), status.alias("status"), (~F.col("answer_a").eqNullSafe(F.col("answer_b"))).alias("answer_changed"), (F.coalesce(F.size("pages_b"), F.lit(0)) - F.coalesce(F.size("pages_a"), F.lit(0))).alias("page_delta"))


def answer_stable_merge(a: DataFrame, b: DataFrame, key: str, answer: str, pages: str, allowed: DataFrame) -> DataFrame:
    """Answers of run a; pages of run b for the allowed keys, else of run a."""
    other = b.select(key, F.col(pages).alias("_pages"))
    listed = allowed.select(key).distinct().withColumn("_ok", F.lit(True))
    return a.join(other, key, "left").join(listed, key, "left").select(key, answer, F.when(F.col("_ok") & F.col("_pages").isNotNull(), F.col("_pages")).otherwise(F.col(pages)).alias(pages))


def drift(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Distinct variants of each column beyond the first; nulls aren't variants."""
    return rows.groupBy(by).agg(*[F.greatest(F.count_distinct(F.col(c)) - 1, F.lit(0)).alias(f"{c}_drift") for c in columns])


def funnel(gold: Column, stages: list[tuple[str, Column]]) -> Column:
    """Name of the first stage that has lost all gold ids, else ``kept``."""
    out = F
    for name, ids in stages:
        out = out.when(~F.coalesce(F.arrays_overlap(gold, ids), F.lit(False)), f"lost_{name}")
    return out.otherwise("kept")


def shares_shift(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Share of each value in two data sets and the difference."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return n.select("value", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias(name))

    x, y = shares(a, "a"), shares(b, "b").withColumnRenamed("value", "value_b")
    both = x.join(y, F.col("value").eqNullSafe(F.col("value_b")), "full_outer")
    left, right = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.select(F.coalesce("value", "value_b").alias("value"), F.round(left, DIGITS).alias("share_a"), F.round(right, DIGITS).alias("share_b"), F.round(right - left, DIGITS).alias("shift"))


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``avg_rank``: ranks from 1, ties share their mean.

    Ranks come from counts of equal values, so the ordered window has one row
    for each distinct value.
    """
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*by, F.lit(1)).orderBy(value))
    ranks = counts.select(*by, value, (upto - F.col("_m") + (F.col("_m") + 1) / 2).alias("avg_rank"))
    return df.join(ranks, [*by, value])


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, w_plus, w_minus and z (normal approximation, average ranks) of paired values."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").select("d", F.abs("d").alias("size"))
    ranks = average_ranks(d, "size")
    sums = ranks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("avg_rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("avg_rank"))), F.lit(0.0)).alias("w_minus"))
    # a long would overflow at 1.7 million pairs
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return sums.select("n", "w_plus", "w_minus", F.round(F.when(n > 0, z).otherwise(0.0), DIGITS).alias("z"))


def bootstrap_mean(df: DataFrame, value: str, rounds: int = 200, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean and bootstrap interval: in each round a row counts as often as a Poisson
    draw says. The sum of such draws is one of their number, so rows of the same value
    draw together, as many as they are, from a generator seeded by (seed, value): reruns
    agree, and the work grows with the distinct values. A task adds up its rows by round;
    only these sums leave it. Null values don't count.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        sums, weights = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            for x, row, n in zip(*(batch.column(c).to_pylist() for c in ("x", "row", "n"))):
                times = np.random.default_rng([seed, row & (1 << 64) - 1]).poisson(n, rounds)
                sums += x * times
                weights += times
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()]), pa.array([weights.tolist()])], ["sums", "weights"])

    rows = df.select(F.col(value).cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.xxhash64("x"))
    parts = rows.mapInArrow(run, "sums array<double>, weights array<double>")
    each = parts.select(F.posexplode(F.arrays_zip("sums", "weights")).alias("round", "s")).groupBy("round").agg((F.sum("s.sums") / F.nullif(F.sum("s.weights"), F.lit(0.0))).alias("m"))
    means = each.where("m is not null")
    tail = (1 - level) / 2
    return means.agg(F.round(F.avg("m"), DIGITS).alias("mean"), F.round(F.percentile("m", F.lit(tail)), DIGITS).alias("low"), F.round(F.percentile("m", F.lit(1 - tail)), DIGITS).alias("high"))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """n, accuracy, F1 at the threshold and AUROC (ties count half)."""
    ranks = average_ranks(df.select(F.col(label).alias("y"), F.col(score).alias("s")).where("y is not null and s is not null"), "s")
    p, y = F.col("s") >= threshold, F.col("y") == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    tp, fp, fn = count(p & y), count(p & ~y), count(~p & y)
    pos, neg = count(y), count(~y)
    auc = F.when((pos > 0) & (neg > 0), (F.sum(F.when(y, F.col("avg_rank"))) - pos * (pos + 1) / 2) / (pos * neg))
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(p == y, 1.0).otherwise(0.0)), DIGITS).alias("accuracy"), F.round(F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), DIGITS).alias("f1"), F.round(auc, DIGITS).alias("auroc"))


def text_noise(text: Column) -> Column:
    """Duplicate lines of a text: lines beyond the first of their kind."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def selected_page_metrics(selected: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: hit_rate, weighted_hit_rate, compare_hit_rate, zero_rate (negative
    questions without a selected page), mean_pages, mean_recall (of questions with
    gold). ``selected`` has qid, pages; ``labels`` qid, gold, weight, scope, source."""
    rows = labels.join(selected, "qid", "left").withColumn("pages", F.coalesce("pages", F.array().cast(selected.schema["pages"].dataType)))
    hit = F.when(F.arrays_overlap("gold", "pages"), 1.0).otherwise(0.0)
    asked = F.size("gold") > 0
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(asked, hit)), DIGITS).alias("hit_rate"),
        F.round(F.sum(F.when(asked, hit * F.col("weight"))) / F.sum(F.when(asked, F.col("weight"))), DIGITS).alias("weighted_hit_rate"),
        F.round(F.avg(F.when(asked & (F.col("scope") == "compare"), hit)), DIGITS).alias("compare_hit_rate"),
        F.round(F.avg(F.when(~asked, F.when(F.size("pages") == 0, 1.0).otherwise(0.0))), DIGITS).alias("zero_rate"),
        F.round(F.avg(F.size("pages")), DIGITS).alias("mean_pages"),
        F.round(F.avg(F.when(asked, F.size(F.array_intersect("gold", "pages")) / F.size("gold"))), DIGITS).alias("mean_recall"),
    )


def hit_rate_by_source(selected: DataFrame, labels: DataFrame) -> DataFrame:
    """source, n, hit_rate of the questions with gold pages."""
    rows = labels.where("size(gold) > 0").join(selected, "qid", "left")
    hit = F.when(F.coalesce(F.arrays_overlap("gold", "pages"), F.lit(False)), 1.0).otherwise(0.0)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), DIGITS).alias("hit_rate"))


def slot_metrics(predicted: DataFrame, slots: DataFrame, most: int = 2) -> DataFrame:
    """qid, slot_recall, complete, over_pruned, overbroad: share of a question's slots
    (qid, slot, pages) that a predicted page fills, whether all are, whether fewer
    pages than slots are predicted while one is unfilled, and whether a document has
    more than ``most`` predicted pages. ``predicted`` has qid, doc, page."""
    pages = predicted.groupBy("qid").agg(F.collect_set("page").alias("found"), F.count_distinct("page").alias("n"))
    broad = predicted.groupBy("qid", "doc").agg(F.count_distinct("page").alias("m")).groupBy("qid").agg((F.max("m") > most).alias("overbroad"))
    filled = F.coalesce(F.arrays_overlap("pages", "found"), F.lit(False)).cast("int")
    rows = slots.join(pages, "qid", "left").groupBy("qid").agg(F.avg(filled).alias("recall"), F.min(filled).alias("all"), F.count(F.lit(1)).alias("slots"), F.max(F.coalesce("n", F.lit(0))).alias("n"))
    out = rows.join(broad, "qid", "left")
    return out.select("qid", F.round("recall", DIGITS).alias("slot_recall"), (F.col("all") == 1).alias("complete"), ((F.col("all") == 0) & (F.col("n") < F.col("slots"))).alias("over_pruned"), F.coalesce("overbroad", F.lit(False)).alias("overbroad"))


def answer_anomalies(answer: Column, kind: Column, pages: Column, seconds: Column, slow: float = 5.0) -> Column:
    """Names of what is odd about an answer, in order."""
    empty = F.coalesce(T.unanswerable(answer), F.lit(True))
    cited = F.coalesce(F.size(pages) > 0, F.lit(False))
    shape = F.coalesce(F.when(kind == "boolean", ~F.lower(answer).isin("yes", "no", "true", "false")).when(kind == "number", T.coerce_number(answer).isNull()).when(kind == "date", T.coerce_date(answer).isNull()), F.lit(False))
    flags = (("unanswered_with_pages", empty & cited), ("answered_without_pages", ~empty & ~cited), ("wrong_type", ~empty & shape), ("slow", F.coalesce(seconds > slow, F.lit(False))), ("citation_left_in", F.coalesce(F.contains(answer, F.lit("(cite:")), F.lit(False))))
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags]), lambda x: x.isNotNull())


def repaired(answer: Column, pages: Column, flags: Column) -> Column:
    """struct<answer, pages>: no pages for what isn't answered, no answer of the
    wrong type, no citation marks in the text."""
    wrong = F.array_contains(flags, "wrong_type")
    text = F.when(wrong, F.lit(None)).when(F.array_contains(flags, "citation_left_in"), T.strip_citations(answer)).otherwise(answer)
    none = F.array_contains(flags, "unanswered_with_pages") | wrong
    return F.struct(text.alias("answer"), F.when(none, F.slice(pages, 1, 0)).otherwise(pages).alias("pages"))


def judge_summary(cheap: DataFrame, strict: DataFrame, marks: tuple[str, ...] = ("accuracy", "grounding", "clarity")) -> DataFrame:
    """One row: cases, pass_rate and the mean of each mark; a case's strict verdict
    goes before its cheap one. Both have qid, passed and the marks."""
    both = cheap.alias("c").join(strict.alias("s"), "qid", "full_outer")
    own = lambda name: F.coalesce(F.col(f"s.{name}"), F.col(f"c.{name}"))
    rows = both.select("qid", own("passed").alias("passed"), *[own(m).alias(m) for m in marks])
    return rows.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("passed").cast("double")), DIGITS).alias("pass_rate"), *[F.round(F.avg(m), DIGITS).alias(m) for m in marks])


def composite_estimate(exact: Column, assistant: Column, grounding: Column, telemetry: Column, latency: Column, penalties: list[tuple[Column, float]], exact_share: float = 0.7) -> Column:
    """(exact_share * exact + rest * assistant) * grounding * telemetry * latency,
    less the penalties of the conditions that hold, not below 0."""
    score = (exact_share * exact + round(1 - exact_share, 12) * assistant) * grounding * telemetry * latency
    for condition, loss in penalties:
        score = score - F.when(condition, loss).otherwise(0.0)
    return F.round(F.greatest(score, F.lit(0.0)), DIGITS)


def fold_of(key: Column, folds: int = 5, seed: int = 7) -> Column:
    """Fold of a row by the hash of its key, the same in every run."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long") % folds).cast("int")


def cross_validation(rows: DataFrame, fit, key: str = "id", label: str = "label", folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """fold, n, accuracy, f1, auroc: each fold scored by ``fit(train)``, a function
    from rows to rows with ``score``, fitted on the others. There are ``folds`` fits."""
    placed = rows.withColumn("fold", fold_of(F.col(key), folds))
    out = [binary_metrics(fit(placed.where(F.col("fold") != k))(placed.where(F.col("fold") == k)), label, "score", threshold).withColumn("fold", F.lit(k)) for k in range(folds)]
    return reduce(DataFrame.unionByName, out).select("fold", "n", "accuracy", "f1", "auroc")


def reference_hit_rate(references: DataFrame, contexts: DataFrame) -> DataFrame:
    """qid, n_refs, n_hit and rate: the share of a question's distinct references
    (qid, refs) that its context chunks (qid, citations) cite between them; 1 without
    references. References and citations are compared trimmed and in lower case."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    cited = contexts.select("qid", F.explode(clean("citations")).alias("ref")).distinct().withColumn("hit", F.lit(1))
    wanted = references.select("qid", F.explode_outer(clean("refs")).alias("ref")).distinct()
    rows = wanted.join(cited, ["qid", "ref"], "left").groupBy("qid").agg(F.count("ref").alias("n_refs"), F.count("hit").alias("n_hit"))
    return rows.withColumn("rate", F.when(F.col("n_refs") > 0, F.round(F.col("n_hit") / F.col("n_refs"), DIGITS)).otherwise(1.0))


def item_coverage(answer: Column, items: Column) -> Column:
    """Share of the gold items whose words the answer has, one after another, whatever
    their case and signs; null without items, 0 for an empty answer."""
    key = lambda c: F.concat(F.lit(" "), T.lookup_key(c), F.lit(" "))
    told = F.coalesce(key(answer), F.lit(""))
    held = F.filter(items, lambda x: (T.lookup_key(x) != "") & F.contains(told, key(x)))
    return F.when(F.size(items) > 0, F.round(F.size(held) / F.size(items), DIGITS))


def support_shape(used: DataFrame, retrieved: DataFrame, gold: DataFrame, wants: DataFrame, most: int = 2) -> DataFrame:
    """qid, over_budget, overbroad and weak_anchor of the questions with used pages.

    ``over_budget``: some document has more than ``most`` used pages. ``overbroad``:
    more pages are used than gold ones and one more, at least 2 and at most 4 being
    allowed. ``weak_anchor``: of a document with a used page, a gold page was retrieved
    and not used; or page 1 (2, the last one retrieved) that the question ``wants``
    (qid, title, second, outcome) was, and isn't among the gold pages. All other tables
    have qid, doc and page.
    """
    u, r, g = (t.select("qid", "doc", "page").distinct() for t in (used, retrieved, gold))
    docs = u.groupBy("qid", "doc").agg(F.count(F.lit(1)).alias("n"))
    own = docs.groupBy("qid").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    allowed = F.least(F.lit(4), F.greatest(F.lit(2), F.coalesce("n_gold", F.lit(0)) + 1))
    ends = r.groupBy("qid", "doc").agg(F.max("page").alias("last"))
    missed = r.join(docs.select("qid", "doc"), ["qid", "doc"], "left_semi").join(u, ["qid", "doc", "page"], "left_anti")
    is_gold = g.withColumn("gold", F.lit(True))
    missed = missed.join(is_gold, ["qid", "doc", "page"], "left").join(ends, ["qid", "doc"]).join(wants, "qid", "left")
    wanted = (F.col("title") & (F.col("page") == 1)) | (F.col("second") & (F.col("page") == 2)) | (F.col("outcome") & (F.col("page") == F.col("last")))
    weak = missed.where(F.coalesce("gold", F.lit(False)) | F.coalesce(wanted, F.lit(False))).select("qid").distinct().withColumn("weak", F.lit(True))
    out = own.join(g.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold")), "qid", "left").join(weak, "qid", "left")
    return out.select("qid", (F.col("most") > most).alias("over_budget"), (F.col("n") > allowed).alias("overbroad"), F.coalesce("weak", F.lit(False)).alias("weak_anchor"))
