"""Strict extraction of typed answers from context rows.

``questions`` has qid, kind (number, date, name, names, boolean) and query;
``context`` has qid, pos, id, title and text. The first row by position that
yields an answer gives it and is cited; what no rule can tell stays unanswered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import text as T
from tessera.functions.classify import first_rule
from tessera.operators.ranking import best_per

# Currencies, words of scale, and phrases of duty and licence.
MONEY = r"(?i)(?:usd|eur|gbp|aed|\$) ?([0-9][0-9,]*(?:\.[0-9]+)?)(?: (million|billion))?"
DATE = r"([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})"
UNITS = ("day", "month", "year", "hour", "percent", "business day")
FORBIDS = r"(?i)\b((shall|must|may) not|no person shall|is (prohibited|not permitted|not valid|not enforceable)|void in all circumstances)\b"
ALLOWS = r"(?i)\b((is|are) (permitted|allowed|entitled|required|obliged|authori[sz]ed)|may (?!not\b)[a-z]+|has the right to)\b"
EXCEPTS = r"(?i)\b(unless|except (where|when|as)|provided that|subject to|save (where|as)|notwithstanding)\b"
ASKS_BAN = r"(?i)\b(prohibited|restricted|void|barred|(must|shall) not|cannot)\b"
CLAIMANTS = r"(?i)\b(claimants?|applicants?|plaintiffs?)\b"
DEFENDANTS = r"(?i)\b(defendants?|respondents?|appellants?)\b"


def money(text: Column, near: str | None = None) -> Column:
    """The first amount of money as text without separators, multiplied out; with
    ``near`` the first that follows it within a sentence, if any does."""

    def of(source: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(source, MONEY, 1), ",", "").try_cast("decimal(38,2)")
        times = F.lower(F.regexp_extract(source, MONEY, 2))
        return value * F.when(times == "million", 1_000_000).when(times == "billion", 1_000_000_000).otherwise(1)

    first = of(text)
    if near:
        first = F.coalesce(of(F.regexp_extract(text, rf"(?i)(?:{near})[^.]*", 0)), first)
    return F.regexp_replace(first.cast("decimal(38,2)").cast("string"), r"\.00$", "")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    value = F.regexp_extract(text, pattern, group)
    return F.when(value != "", value)


def number(query: Column, text: Column) -> Column:
    """An amount, a law's number, a year or a quantity, as the question asks."""
    q = F.lower(query)
    rules = [(q.rlike("claim") & ~q.rlike("cost") & q.rlike("amount|value"), money(text, "claim")), (q.rlike("fine|penalty"), money(text, "fine|penalty")), (q.rlike("amount|how much|value|costs?"), money(text)), (q.rlike(r"law (number|no)"), _found(text, r"(?i)\blaw no\.? ?([0-9]+)")), (q.rlike(r"(what|which) year"), _found(text, r"\b((?:19|20)[0-9]{2})\b"))]
    rules += [(q.rlike(rf"how many {u}s?\b|{u}s?\b"), _found(text, rf"(?i)\b([0-9]+(?:\.[0-9]+)?) {u}s?\b")) for u in UNITS]
    return first_rule(rules, None)


def date(text: Column) -> Column:
    """The first date as yyyy-MM-dd."""
    return F.date_format(F.try_to_timestamp(_found(text, DATE), F.lit("d MMMM yyyy")), "yyyy-MM-dd")


def parties(query: Column, title: Column) -> Column:
    """The parties on the side of the caption that the question's roles name;
    null unless it names one side."""
    left, right = query.rlike(CLAIMANTS), query.rlike(DEFENDANTS)
    sides = T.caption_parties(F.regexp_replace(title, r"^[A-Z]+ [0-9]+/[0-9]+ ", ""))
    side = F.when(left & ~right, F.get(sides, F.lit(0))).when(right & ~left, F.get(sides, F.lit(1)))
    return F.filter(F.transform(F.split(side, r",| and | & "), lambda p: F.trim(F.regexp_replace(p, r"^\(?[0-9]+[).] *", ""))), lambda p: p != "")


def strict_answers(questions: DataFrame, context: DataFrame, most: int = 4) -> DataFrame:
    """qid, answer, cited: of each question that a rule can answer from its first
    ``most`` context rows.

    A date after 'in force' goes before others if the question asks for that. A
    boolean needs a question that names an article, law or regulation, and rows
    that forbid or allow, not both, and state no exception; it cites these rows.
    """
    rows = best_per(context, ["qid"], [F.asc("pos"), F.asc("id")], most, "place").join(questions, "qid")
    force = F.when(F.lower("query").rlike(r"in(to)? force"), date(F.regexp_extract("text", rf"(?i)in force (?:on )?{DATE}", 0)))
    names = parties(F.col("query"), F.col("title"))
    value = F.when(F.col("kind") == "number", number(F.col("query"), F.col("text"))).when(F.col("kind") == "date", F.coalesce(force, date(F.col("text")))).when(F.col("kind") == "name", F.get(names, F.lit(0))).when(F.col("kind") == "names", F.when(F.size(names) > 0, F.array_join(names, ", ")))
    typed = rows.where("kind <> 'boolean'").select("qid", "place", F.col("id").cast("string").alias("id"), value.alias("answer"), force.isNotNull().alias("first")).where("answer is not null")
    typed = best_per(typed, ["qid"], [F.desc("first"), F.asc("place")], 1, "n").select("qid", "answer", F.array("id").alias("cited"))
    asked = rows.where((F.col("kind") == "boolean") & F.col("query").rlike(r"(?i)\barticle [0-9]+|\b(law|regulations?)\b"))
    signs = asked.select("qid", "query", "place", F.col("id").cast("string").alias("id"), F.col("text").rlike(FORBIDS).alias("no"), F.col("text").rlike(ALLOWS).alias("yes"), F.col("text").rlike(EXCEPTS).alias("but"))
    sums = signs.groupBy("qid", "query").agg(F.bool_or("no").alias("no"), F.bool_or("yes").alias("yes"), F.bool_or("but").alias("but"), F.transform(F.array_sort(F.collect_list(F.when(F.col("no") | F.col("yes"), F.struct("place", "id")))), lambda x: x["id"]).alias("cited"))
    sure = sums.where("(no or yes) and not (no and yes) and not but")
    told = sure.select("qid", F.when(F.col("query").rlike(ASKS_BAN) == F.col("no"), "Yes").otherwise("No").alias("answer"), "cited")
    return typed.unionByName(told)
