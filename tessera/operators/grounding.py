"""Evidence selection, slot audits and claim support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import text as T
from tessera.operators.ranking import best_per, share_of
from tessera.operators.retrieval import DIGITS
from tessera.session import stored


def evidence_scores(signals: DataFrame) -> DataFrame:
    """qid, page, score: sums of the weighted signals (qid, page, weight)."""
    return signals.groupBy("qid", "page").agg(F.round(F.sum("weight"), DIGITS).alias("score"))


def select_pages(scores: DataFrame, budget: int) -> DataFrame:
    return best_per(scores, ["qid"], [F.desc("score"), F.asc("page")], budget)


def slot_audit(required: DataFrame, support: DataFrame) -> DataFrame:
    """qid, slots, covered, ratio. ``required(qid, slot, least_docs)``; a slot is
    covered if pages of at least ``least_docs`` documents support it."""
    held = support.groupBy("qid", "slot").agg(F.count_distinct("doc").alias("docs"))
    both = required.join(held, ["qid", "slot"], "left")
    ok = F.when(F.coalesce("docs", F.lit(0)) >= F.col("least_docs"), 1).otherwise(0)
    return both.groupBy("qid").agg(F.count(F.lit(1)).alias("slots"), F.sum(ok).alias("covered"), F.round(F.avg(ok), DIGITS).alias("ratio"))


def necessary(support: DataFrame) -> DataFrame:
    """qid, page, necessary: whether a slot would lose its last page without it."""
    w = Window.partitionBy("qid", "slot")
    alone = support.select("qid", "page", "slot").distinct().withColumn("n", F.count(F.lit(1)).over(w))
    return alone.groupBy("qid", "page").agg(F.bool_or(F.col("n") == 1).alias("necessary"))


def best_set(candidates: DataFrame) -> DataFrame:
    """Of the page sets (qid, name, pages, score) the best, then smallest, then first by name."""
    return best_per(candidates, ["qid"], [F.desc("score"), F.asc(F.size("pages")), F.asc("name")]).drop("place")


def claims(answers: DataFrame, id_col: str = "qid", text_col: str = "answer") -> DataFrame:
    """qid, pos, claim: the sentences of an answer."""
    return answers.select(F.col(id_col).alias("qid"), F.posexplode(T.sentences(F.col(text_col))).alias("pos", "claim"))


def support_class(claim: Column, source: Column, least: float = 0.62) -> Column:
    """exact if the source contains the claim, overlap if it has enough of its tokens, else none."""
    exact = F.contains(F.lower(T.collapse(source)), F.lower(T.collapse(claim)))
    return F.when(exact, "exact").when(share_of(T.tokens(claim), T.tokens(source)) >= least, "overlap").otherwise("none")


def compile_proof(rows: DataFrame, partial: bool = True, least: float = 0.5) -> DataFrame:
    """qid, answer, coverage: supported claims in order. Without ``partial`` an
    answer with less than ``least`` of its claims supported is blank."""
    ok = F.col("support") != "none"
    out = rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "claim")))), lambda x: x["claim"]), " ").alias("answer"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), DIGITS).alias("coverage"))
    return out if partial else out.withColumn("answer", F.when(F.col("coverage") < least, "").otherwise(F.col("answer")))


def coverage_gaps(wanted: Column, held: Column) -> Column:
    return F.array_sort(F.array_except(wanted, held))


def adjacent_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """qid, doc, page of neighbours of the hits that continue them: the hit ends
    without a final stop, or begins in lower case. ``pages`` has doc, page, text."""
    rows = hits.join(pages, ["doc", "page"])
    after = rows.where(~F.trim("text").rlike(r"[.!?]$")).select("qid", "doc", (F.col("page") + 1).alias("page"))
    before = rows.where(F.trim("text").rlike("^[a-z]")).select("qid", "doc", (F.col("page") - 1).alias("page"))
    found = after.union(before).distinct().join(pages.select("doc", "page"), ["doc", "page"], "left_semi")
    return found.join(hits, ["qid", "doc", "page"], "left_anti").select("qid", "doc", "page")


def run_keys(rows: DataFrame, id_col: str, words: int) -> DataFrame:
    """id_col, key: a hash of each run of ``words`` words of ``w``, from the words' hashes."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        factors = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(words)], np.uint64)
        for batch in batches:
            h, sizes = batch.column("h").flatten().to_numpy().view(np.uint64), batch.column("h").value_lengths().to_numpy()
            n = len(h) - words + 1
            if n > 0:
                at = np.repeat(np.arange(len(sizes)), sizes)
                key = sum(h[k : k + n] * factors[k] for k in range(words)).view(np.int64)
                whole = np.flatnonzero(at[:n] == at[words - 1 :])
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(at[whole])), pa.array(key[whole])], [id_col, "key"])

    hashed = rows.select(id_col, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    return hashed.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, key long")


def contained(passages: DataFrame, docs: DataFrame, words: int = 8) -> DataFrame:
    """item_id, doc_id of the passages that are part of a document's text.

    The words inside a passage (all but its first and last, which may be cut) are
    words of the document too. So passages and documents meet in an equality join
    on a hash of the first ``words`` inner words, or, for short passages, of the
    first one; only ids travel until then, and only the texts of such pairs are
    compared: pairs are a table, so that the planner knows when they are few and
    leaves the texts where they are. Passages of one or two words have no inner word
    and are compared with all texts.
    """
    asked = passages.select("item_id", F.col("text").alias("passage"), T.tokens(F.col("text")).alias("w")).where("passage is not null")
    inner = asked.select("item_id", "passage", F.slice("w", 2, words).alias("w"), (F.size("w") - 2).alias("n"))
    rows = docs.select("doc_id", T.tokens(F.col("text")).alias("w"))
    long = run_keys(rows, "doc_id", words).join(run_keys(inner.where(F.col("n") >= words), "item_id", words), "key")
    short = rows.select("doc_id", F.explode(F.array_distinct("w")).alias("key")).join(inner.where((F.col("n") >= 1) & (F.col("n") < words)).select("item_id", F.col("w")[0].alias("key")), "key")
    pairs = stored(long.select("item_id", "doc_id").union(short.select("item_id", "doc_id")).distinct())
    texts = docs.select("doc_id", "text")
    found = pairs.join(texts, "doc_id").join(asked.select("item_id", "passage"), "item_id").where(F.contains("text", "passage"))
    tiny = texts.join(inner.where("n < 1").select("item_id", "passage"), F.contains("text", "passage"))
    return found.select("item_id", "doc_id").union(tiny.select("item_id", "doc_id")).distinct()


def escalation(family: Column, success: Column, n_pages: Column, n_selected: Column, strong: Column, margin: Column, failed: Column, compares: Column, laws: Column, page_scores: Column, authority: Column, least_margin: float = 0.06, least_page_margin: float = 0.2, least_authority: float = 0.95) -> Column:
    """struct<escalate, reasons>: whether the search for evidence should go on, and why.

    It never does for questions without a ``family``, nor where the audit succeeded
    and there are no other pages or the selected ones are ``strong``. Reasons in order:
    the rerank ``margin`` is small; typed slots ``failed``, among them a side of a
    comparison; pages of several ``laws`` compete; the best two ``page_scores`` are
    close; no page has enough ``authority``.
    """
    done = F.coalesce(success, F.lit(False)) & ((n_pages <= F.greatest(n_selected, F.lit(1))) | F.coalesce(strong, F.lit(False)))
    best = F.sort_array(page_scores, asc=False)
    close = (F.size(best) > 1) & (F.get(best, F.lit(0)) - F.get(best, F.lit(1)) < least_page_margin) & ~(F.coalesce(F.array_max(authority), F.lit(0.0)) >= least_authority)
    found = (
        ("low_rerank_confidence", margin < least_margin), ("typed_slots_missing", F.size(failed) > 0), ("compare_missing_side", compares & F.array_contains(failed, "compare_docs")),
        ("law_family_ambiguous", F.size(F.array_distinct(laws)) > 1), ("page_margin_close", close), ("no_strong_authoritative_hit", ~F.coalesce(F.array_max(authority) >= least_authority, F.lit(False))),
    )
    open_ = F.coalesce(family, F.lit("")) != ""
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)) & open_ & ~done, F.lit(n)) for n, c in found]), lambda x: x.isNotNull())
    return F.struct((F.size(reasons) > 0).alias("escalate"), reasons.alias("reasons"))
