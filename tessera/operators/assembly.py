"""Putting rows together: scopes, references, prompts, sources, submissions; and
outside models plugged in as functions of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text as T
from tessera.operators.ranking import best_per
from tessera.operators.retrieval import DIGITS


def unique_pages_first(rows: DataFrame, by: str = "qid", page: str = "page", order: str = "rank") -> DataFrame:
    """``rows`` with ``slot``: the first row of each page in order, then the rest in order."""
    seen = F.row_number().over(Window.partitionBy(by, page).orderBy(order))
    return rows.withColumn("again", seen > 1).withColumn("slot", F.row_number().over(Window.partitionBy(by).orderBy("again", order))).drop("again")


def instructed_query(query: Column, kind: Column, references: Column) -> Column:
    """The query with what a reranker is to look for: the kind of answer, and the
    references if there are any. An open question is left as it is."""
    named = F.when(F.size(references) > 0, F.concat(F.lit("Prefer passages of: "), F.array_join(references, "; ")))
    wanted = F.when(~F.coalesce(kind, F.lit("free_text")).isin("free_text"), F.concat(F.lit("Find the passage that states the "), kind))
    return F.concat_ws("\n", wanted, named, query)


def rescored(rows: DataFrame, scorer: Callable[[Column, Column], Column], query: str = "query", text: str = "text", name: str = "rerank") -> DataFrame:
    """``rows`` with the score that ``scorer`` (a pandas UDF, or any function of two
    columns) gives to query and text, rounded. Rows without either score null."""
    both = F.col(query).isNotNull() & F.col(text).isNotNull()
    some = rows.where(both).withColumn(name, F.round(scorer(F.col(query), F.col(text)), DIGITS).cast("double"))
    return some.unionByName(rows.where(~both).withColumn(name, F.lit(None).cast("double")))


def encoded(rows: DataFrame, encoder: Callable[[Column], Column], text: str = "text", name: str = "vector") -> DataFrame:
    """``rows`` with what ``encoder`` makes of their text; equal texts are encoded
    once. A null text has no vector."""
    once = rows.select(F.col(text).alias("encoded_text")).where("encoded_text is not null").distinct().withColumn(name, encoder(F.col("encoded_text")))
    return rows.join(once, F.col(text) == F.col("encoded_text"), "left").drop("encoded_text")


def document_scope(hits: DataFrame, questions: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """qid, doc, score, place: the documents that a question may use: by their
    summed scores, as many as its mode (``questions(qid, mode)``) has a budget for,
    one for a mode without."""
    totals = hits.groupBy("qid", "doc").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    budget = F.lit(1)
    for mode, n in budgets.items():
        budget = F.when(F.col("mode") == mode, n).otherwise(budget)
    placed = best_per(totals, ["qid"], [F.desc("score"), F.asc("doc")], 1 << 30)
    return placed.join(questions, "qid").where(F.col("place") <= budget).select("qid", "doc", "score", "place")


def with_references(chunks: DataFrame, pattern: str, doc: str = "doc", text: str = "text", held: str = "refs") -> DataFrame:
    """``chunks`` with the references of their whole document: those they hold
    already and those that the document's texts name now, sorted."""
    found = F.array_union(F.coalesce(held, F.array().cast("array<string>")), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))
    whole = chunks.select(F.col(doc).alias("of_doc"), F.explode(found).alias("ref")).groupBy("of_doc").agg(F.array_sort(F.collect_set("ref")).alias("all_refs"))
    out = chunks.join(whole, F.col(doc) == F.col("of_doc"), "left").withColumn(held, F.coalesce("all_refs", F.array().cast("array<string>")))
    return out.drop("of_doc", "all_refs")


def submission(results: DataFrame) -> DataFrame:
    """question_id and payload (JSON) of results (qid, kind, answer, pages, seconds):
    null for what isn't answered, booleans as such, pages by document."""
    told = F.when(~F.coalesce(T.unanswerable(F.col("answer")), F.lit(True)), F.col("answer"))
    split = results.select("qid", "kind", told.alias("told"), "seconds", F.explode_outer("pages").alias("page"))
    parts = T.split_page_id(F.col("page"))
    docs = split.groupBy("qid", "kind", "told", "seconds", parts["doc"].alias("doc")).agg(F.array_sort(F.collect_set(parts["page"])).alias("pages"))
    rows = docs.groupBy("qid", "kind", "told", "seconds").agg(F.array_sort(F.collect_list(F.when(F.col("doc").isNotNull(), F.struct("doc", "pages")))).alias("sources"))
    answer = F.when(F.col("kind") == "boolean", F.when(F.lower("told").isin("yes", "true"), "true").when(F.lower("told").isin("no", "false"), "false")).otherwise(F.col("told"))
    payload = F.struct(answer.alias("answer"), F.when(F.col("told").isNull(), F.slice("sources", 1, 0)).otherwise(F.col("sources")).alias("sources"), F.round(F.col("seconds") * 1000).cast("long").alias("total_ms"))
    return rows.select(F.col("qid").alias("question_id"), F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def context_text(rows: DataFrame) -> DataFrame:
    """qid and context: numbered passages (qid, pos, id, title, text) in order, each
    under its id and title, to stand in a prompt."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.col("id").cast("string"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" | "), "title")).otherwise(""), F.lit("\n"), F.trim(F.coalesce("text", F.lit(""))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("context"))


def prompt(question: Column, context: Column, kind: Column, words: int) -> Column:
    """A prompt for one question over its context, with the form of answer."""
    form = F.when(kind == "boolean", "Answer yes or no.").when(kind == "number", "Answer with a number alone.").when(kind == "date", "Answer with a date as YYYY-MM-DD.").when(kind.isin("name", "names"), "Answer with names alone.").otherwise(f"Answer in at most {words} words and cite passages by number.")
    return F.concat_ws("\n\n", F.lit("Use only these passages."), context, F.concat(F.lit("Question: "), question), form)


def capped_sources(pages: DataFrame, most_pages: int, most_chars: int) -> DataFrame:
    """qid and sources: the first pages' texts (qid, pos, page, text) in order, cut
    where the characters are used up."""
    w = Window.partitionBy("qid").orderBy("pos", "page")
    rows = pages.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most_pages).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("before", F.sum(F.length("text")).over(w) - F.length("text")).where(F.col("before") < most_chars)
    cut = F.substring(F.col("text"), F.lit(1), F.lit(most_chars) - F.col("before").cast("int"))
    line = F.concat(F.lit("--- "), F.col("page").cast("string"), F.lit("\n"), cut)
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("sources"))


def numbered_list(items: Column, lead: str = "") -> Column:
    """Distinct items as a numbered list in one text; empty for none."""
    once = F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")))
    lines = F.transform(once, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.trim(x)))
    return F.when(F.size(once) > 0, F.concat(F.lit(lead), F.array_join(lines, "\n"))).otherwise("")


def profile(text: Column, kinds: dict[str, str]) -> Column:
    """struct of the number of distinct entities of each kind (name: pattern), and
    ``complexity``: 1 for each kind present, 1 for 20 words, 1 for a second question."""
    counts = {name: F.size(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)))) for name, p in kinds.items()}
    score = F.when(T.token_count(text) > 20, 1).otherwise(0) + F.when(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\?")) > 1, 1).otherwise(0)
    for c in counts.values():
        score = score + F.when(c > 0, 1).otherwise(0)
    return F.struct(*[c.alias(n) for n, c in counts.items()], score.cast("int").alias("complexity"))


def merge_slots(order: Column, ranked: Column, candidates: Column) -> Column:
    """``order`` with its candidates in the order of ``ranked``, each at a place that a
    candidate held; the others stay where they are. Null unless ``ranked`` names every
    candidate of ``order`` once and nothing else, and null where an input is."""
    held = F.filter(order, lambda x: F.array_contains(candidates, x))
    same = (F.array_sort(ranked) == F.array_sort(held)) & (F.size(F.array_distinct(ranked)) == F.size(ranked))
    return F.when(same, F.transform(order, lambda x: F.coalesce(F.get(ranked, F.array_position(held, x).cast("int") - 1), x)))
