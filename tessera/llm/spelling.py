"""Spelling variants: words one replaced, inserted or deleted code point apart.

A word of L code points is in L wildcard groups, (position, prefix, suffix): the
words of a group differ in that position alone, so there are at most as many as
letters. A group keeps its size and its two best words; a member has size - 1 near
words there, of which the best is the first or, for the first, the second. What a
word is without one code point joins the vocabulary: the words that it is found in
are summed up by that shorter word, and those that it finds by the longer one. The
sums of a word over its groups give its number of near words and the best of them;
no two members of a group are ever paired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import stored

#: The letters of a word, beside A-Z.
LETTERS = "a-zA-Z\\u00C0-\\u00FF"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """Words of at least ``length`` code points that occur ``occurs`` times. A form
    occurs at least ``ratio`` times as often as its variant. A run loses a code point
    where ``every`` divides its hash (0: never)."""

    length: int = 6
    occurs: int = 5
    ratio: int = 5
    every: int = 199


def vocabulary(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the distinct words of all texts and how often they occur."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{settings.length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(found).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWERED).alias("word"))
    if settings.every:
        runs = runs.withColumn("h", F.crc32(F.encode(F.concat("doc", F.lit(":"), "word"), "UTF-8")))
        at = F.pmod("h", F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.pmod("h", F.lit(settings.every)) == 0, less).otherwise(F.col("word")))
    return runs.where(F.length("word") >= settings.length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= settings.occurs)


def _best(n: str, word: str):
    """Least is best: the most frequent, of these the first in code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """word, near (how many words are near) and best (less: minus the n of the best
    of them; word) for each word of ``words(word, n)`` with a near word."""
    size = F.length("word")
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("at"), F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, size)).alias("rest")))
    shorter = words.select("word", "n", F.inline(cut))
    groups = shorter.groupBy("at", "rest").agg(F.sort_array(F.collect_list(_best("n", "word"))).alias("all")).where("size(all) > 1")
    of_group = groups.select(F.explode("all").alias("own"), (F.size("all") - 1).cast("long").alias("near"), F.slice("all", 1, 2).alias("top"))
    replaced = of_group.select("own.word", "near", F.when(F.expr("own.word = top[0].word"), F.expr("top[1]")).otherwise(F.expr("top[0]")).alias("best"))

    # a letter doubled is cut to the same word twice
    once = shorter.select("word", "n", "rest").distinct()
    longer = once.groupBy("rest").agg(F.count(F.lit(1)).alias("near"), F.min(_best("n", "word")).alias("best"))
    inserted = longer.join(words.select("word"), F.col("rest") == F.col("word")).select("word", "near", "best")
    known = words.select(F.col("word").alias("rest"), F.col("n").alias("m"))
    deleted = once.join(known, "rest").select("word", F.lit(1).cast("long").alias("near"), _best("m", "rest").alias("best"))
    return replaced.union(inserted).union(deleted).groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last of each word's forms, for ``forms(word, form)`` where
    a form occurs more often than its word, so no chain returns. Pointers double, so
    rounds grow with the logarithm of the longest chain."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        at = step.drop("moved")


def variants(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of the vocabulary.

    The form is the near word of largest n, the first in code-point order of several,
    if it occurs ``ratio`` times as often; else null, and the root is the word itself.
    Null and empty texts have no words; a null id counts as an empty one. Rows that
    repeat count each. Other columns are ignored.
    """
    words = stored(vocabulary(docs, settings, id_col, text_col))
    best = F.expr(f"-best.less >= {settings.ratio} * n")
    judged = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"), F.when(best, F.col("best.word")).alias("form"), F.when(best, -F.col("best.less")).alias("form_n"))
    judged = stored(judged)
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
