"""Context guarantees, topic rules, pairs of pages and retrieval expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text as T
from tessera.operators.metrics import f_beta
from tessera.operators.ranking import best_per, share_of
from tessera.operators.retrieval import DIGITS


def diversify(hits: DataFrame, reserve: DataFrame, least: int, doc_col: str = "doc", limit: int = 40) -> DataFrame:
    """Hits of queries with fewer than ``least`` documents, extended by the best
    reserve rows of other documents; other queries are unchanged."""
    few = hits.groupBy("qid").agg(F.count_distinct(doc_col).alias("n")).where(F.col("n") < least).select("qid")
    more = reserve.join(few, "qid", "left_semi").join(hits.select("qid", doc_col).distinct(), ["qid", doc_col], "left_anti")
    more = best_per(more, ["qid"], [F.desc("score"), F.asc("id")], limit).drop("place")
    return hits.select(*more.columns).withColumn("extra", F.lit(False)).unionByName(more.withColumn("extra", F.lit(True)))


def entity_variants(query: Column, entity: str, provision: str) -> Column:
    """Query texts aimed at each entity and provision that the query names."""
    names = F.array_distinct(F.regexp_extract_all(query, F.lit(entity), F.lit(0)))
    refs = F.array_distinct(F.regexp_extract_all(query, F.lit(provision), F.lit(0)))
    return F.concat(names, F.transform(refs, lambda r: F.concat_ws(" ", r, F.array_join(names, " "))))


def first_segment(chunks: DataFrame, segments: DataFrame, opening: int = 80) -> DataFrame:
    """id, segment: of the segments on a chunk's page (page, segment, pos, kind,
    text) the first that holds its opening characters or is structural."""
    both = chunks.select("id", "page", F.substring(F.trim("text"), 1, opening).alias("opening")).join(segments.select("page", "segment", "pos", "kind", F.col("text").alias("body")), "page", "left")
    ok = F.contains("body", "opening") | F.col("kind").isin("article", "section", "schedule")
    best = best_per(both.where(ok), ["id"], [F.asc("pos"), F.asc("segment")])
    return chunks.select("id").join(best.select("id", "segment"), "id", "left")


def mentions(texts: DataFrame, titles: DataFrame, longest: int = 6) -> DataFrame:
    """src, dst: texts (src, text) that name a title (dst, title) other than
    their own. Titles are matched as token n-grams, an equality join."""
    words = T.tokens(F.col("text"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))))
    named = texts.select("src", F.explode(F.array_distinct(grams)).alias("key"))
    keyed = titles.select("dst", F.array_join(T.tokens(F.col("title")), " ").alias("key"))
    return named.join(keyed, "key").where("src <> dst").select("src", "dst").distinct()


def uncrowd(ranked: DataFrame, k: int, doc_col: str = "doc") -> DataFrame:
    """First ``k`` rows of each query; if one document fills them all, the best
    row of another takes the last place."""
    top = ranked.where(F.col("rank") <= k)
    crowded = top.groupBy("qid").agg(F.count_distinct(doc_col).alias("docs"), F.min(doc_col).alias("only")).where("docs = 1").select("qid", "only")
    other = ranked.join(crowded, "qid").where((F.col("rank") > k) & (F.col(doc_col) != F.col("only"))).drop("only")
    other = best_per(other, ["qid"], [F.asc("rank")]).drop("place")
    kept = top.join(other.select("qid").withColumn("_swap", F.lit(True)), "qid", "left").where(~(F.coalesce("_swap", F.lit(False)) & (F.col("rank") == k))).drop("_swap")
    return kept.unionByName(other.withColumn("rank", F.lit(k)))


def best_subset(rows: DataFrame, most: int = 10) -> DataFrame:
    """qid, ids, value: the subset of a query's first ``most`` candidates (qid, id,
    pos, gain, cost) with the greatest gain minus cost; smaller masks win ties.

    At most 2^most masks for a query, as expressions over one array.
    """
    few = rows.where(F.col("pos") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "gain", "cost"))).alias("c"))
    masks = few.select("qid", "c", F.explode(F.sequence(F.lit(0), (F.shiftleft(F.lit(1), most) - 1).cast("int"))).alias("mask")).where("mask < shiftleft(1, size(c))")
    picked = masks.withColumn("picked", F.expr("filter(c, (x, i) -> (shiftright(mask, i) & 1) = 1)")).drop("c")
    value = F.round(F.aggregate("picked", F.lit(0.0), lambda s, x: s + x["gain"] - x["cost"]), DIGITS)
    best = best_per(picked.withColumn("value", value), ["qid"], [F.desc("value"), F.asc("mask")])
    return best.select("qid", F.transform("picked", lambda x: x["id"]).alias("ids"), "value")


def rank_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """qid, common, moved: ids in both first k, and those at another rank."""
    x, y = a.where(F.col("rank") <= k).select("qid", "id", "rank"), b.where(F.col("rank") <= k).select("qid", "id", F.col("rank").alias("other"))
    both = x.join(y, ["qid", "id"], "left")
    return both.groupBy("qid").agg(F.count("other").alias("common"), F.sum(F.when(F.col("other") != F.col("rank"), 1).otherwise(0)).alias("moved"))


def best_support(fragments: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, pos, id, score: for each answer fragment the chunk of its query that
    covers most of its tokens; an exact mention counts one more."""
    both = fragments.join(chunks, "qid")
    score = F.round(share_of(T.tokens(F.col("fragment")), T.tokens(F.col("text"))) + F.when(F.contains(F.lower("text"), F.lower("fragment")), 1.0).otherwise(0.0), DIGITS)
    return best_per(both.withColumn("score", score), ["qid", "pos"], [F.desc("score"), F.asc("id")]).select("qid", "pos", "id", "score")


def topic_scores(chunks: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """id, topic, score: weights of the rules (topic, pattern, weight) whose pattern
    a chunk matches; topics without a match are left out."""
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(t).alias("topic"), F.lit(float(w)).alias("w"))) for t, p, w in rules]), lambda x: x.isNotNull())
    return chunks.select("id", F.inline(hits)).groupBy("id", "topic").agg(F.round(F.sum("w"), DIGITS).alias("score"))


def guarantee_each(rows: DataFrame, k: int, ref: str = "ref") -> DataFrame:
    """``k`` rows of each query by rank, with the best row of every reference among
    them as far as there is room."""
    first = F.row_number().over(Window.partitionBy("qid", ref).orderBy("rank", "id"))
    marked = rows.withColumn("_must", first == 1)
    return best_per(marked, ["qid"], [F.desc("_must"), F.asc("rank"), F.asc("id")], k).drop("_must", "place")


def page_pairs(pages: DataFrame, first: str, second: str) -> DataFrame:
    """qid, a, b: best page of role ``first`` with the best of role ``second`` of the
    same document."""
    role = lambda r, n: best_per(pages.where(F.col("role") == r), ["qid", "doc"], [F.desc("score"), F.asc("page")]).select("qid", "doc", F.col("page").alias(n))
    return role(first, "a").join(role(second, "b"), ["qid", "doc"])


def largest_amount(chunks: DataFrame, by: str = "doc", order: str = "pos") -> DataFrame:
    """Largest amount of money in each document's chunks; the first chunk wins ties.
    Thousands separators go; million and billion multiply."""
    pattern = r"([0-9][0-9,]*(?:\.[0-9]+)?)(?: (million|billion))?"
    whole = F.explode(F.regexp_extract_all("text", F.lit(r"(?:USD|EUR|\$) ?([0-9][0-9,]*(?:\.[0-9]+)?(?: (?:million|billion))?)"), F.lit(1))).alias("m")
    rows = chunks.select(by, order, whole)
    unit = F.regexp_extract("m", pattern, 2)
    amount = F.regexp_replace(F.regexp_extract("m", pattern, 1), ",", "").try_cast("decimal(27,2)") * F.when(unit == "million", 10**6).when(unit == "billion", 10**9).otherwise(1).cast("decimal(10,0)")
    return best_per(rows.withColumn("amount", amount.cast("double")), [by], [F.desc_nulls_last("amount"), F.asc(order)]).select(by, "amount", order)


def page_facts(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """id, kind, value: every distinct match of the rules (kind, pattern) on a page."""

    def values(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return pages.select("id", F.inline(F.flatten(F.array(*[values(k, p) for k, p in rules]))))


def lexical_segments(segments: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """qid, id, hits, place: segments (id, ref, tokens) by shared tokens with
    questions (qid, ref, tokens); those of the question's reference only, unless
    there is none."""
    asked = questions.select("qid", F.col("ref").alias("wanted"), F.explode(F.array_distinct("tokens")).alias("term"))
    held = segments.select("id", "ref", F.explode(F.array_distinct("tokens")).alias("term"))
    hits = held.join(asked, "term").groupBy("qid", "id", "ref", "wanted").agg(F.count(F.lit(1)).alias("hits"))
    hits = hits.withColumn("level", (F.col("ref") != F.col("wanted")).cast("int"))
    hits = hits.join(hits.groupBy("qid").agg(F.min("level").alias("best")), "qid").where("level = best or best = 1")
    return best_per(hits, ["qid"], [F.desc("hits"), F.asc("id")], k).select("qid", "id", "hits", "place")


def windows_around(text: Column, anchor: str, before: int, after: int) -> Column:
    """Text around each anchor, joined by ' ... '."""
    return F.array_join(F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{before}}}{anchor}.{{0,{after}}}"), F.lit(0)), " ... ")


def twin_effect(rows: DataFrame, beta: float = 2.5) -> DataFrame:
    """qid, full, alone: F-beta of the found pages with and without those of the
    twin document. ``rows`` has qid, gold, found and twin, arrays of pages."""
    return rows.select("qid", F.round(f_beta(F.col("gold"), F.col("found"), beta), DIGITS).alias("full"), F.round(f_beta(F.col("gold"), F.array_except("found", "twin"), beta), DIGITS).alias("alone"))


def activated_rules(rows: DataFrame, rules: list[tuple[str, str]], least: int) -> DataFrame:
    """rule, support, promoted: rows that match each rule's pattern."""
    hit = F.explode(F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull()))
    return rows.select(hit.alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("support")).withColumn("promoted", F.col("support") >= least)


def document_shortlist(chunks: DataFrame, keep: DataFrame | None = None, per: int = 2, references: int = 4) -> DataFrame:
    """The chunks (qid, ref, pos, doc, id, doc_score, score) of a question's shortlisted
    documents.

    For each of a question's first ``references`` references (by ``pos``) the ``per``
    documents with the highest score above 0, then the best chunk, then the last id;
    and the documents of ``keep`` (qid, doc). A question without any keeps all rows.
    """
    docs = chunks.where(F.col("pos") < references).groupBy("qid", "pos", "doc").agg(F.max("doc_score").alias("doc_score"), F.max("score").alias("best")).where("doc_score > 0")
    chosen = best_per(docs, ["qid", "pos"], [F.desc("doc_score"), F.desc("best"), F.desc("doc")], per).select("qid", "doc")
    chosen = (chosen if keep is None else chosen.unionByName(keep.select("qid", "doc"))).distinct()
    some = chosen.select("qid").distinct()
    return chunks.join(chosen, ["qid", "doc"], "left_semi").unionByName(chunks.join(some, "qid", "left_anti").select(*chunks.columns), allowMissingColumns=False).select(*chunks.columns)


def promotion(reversible: Column, runs: Column, score: Column, gain: Column, overall_gain: Column, safe: Column, false_positives: Column, tokens: Column, least_score: float = 0.65, least_runs: int = 2, most_false: float = 0.15, most_tokens: int = 120) -> Column:
    """struct<status, reason>: whether a rule that was tried may be kept. ``pending``
    until it ran often enough; ``rejected`` for the first thing that speaks against it;
    else ``accepted``. Null counts as not reversible, 0 or safe."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    told = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    out = F.when(~F.coalesce(reversible, F.lit(False)), told("rejected", "not reversible")).when(zero(runs) < least_runs, told("pending", "too few runs")).when(zero(score) < least_score, told("rejected", "score"))
    out = out.when((zero(gain) <= 0) & (zero(overall_gain) <= 0), told("rejected", "no gain")).when(~F.coalesce(safe, F.lit(True)), told("rejected", "not safe"))
    return out.when(zero(false_positives) > most_false, told("rejected", "false positives")).when(zero(tokens) > most_tokens, told("rejected", "size")).otherwise(told("accepted", ""))
