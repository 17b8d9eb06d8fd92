"""Metrics, votes, drift, percentiles and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import text as T
from tessera.operators import grounding, metrics, models, ranking
from tessera.queries.registry import Tables, query

A, B = "list_filter([doc_id, doc_id + 1, doc_id + 2], lambda x: x % 3 <> 0)", "list_filter([doc_id + 1, doc_id + 2], lambda x: x % 2 = 0)"


def id_lists(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.labels.select("doc_id", "quality", "toxic", F.filter(F.array(d, d + 1, d + 2), lambda x: x % 3 != 0).alias("gold"), F.filter(F.array(d + 1, d + 2), lambda x: x % 2 == 0).alias("found"))


@query("AG-16 GR-1", f"""
with x as (select doc_id, {A} as g, {B} as f from labels), y as (select doc_id, len(g) as ng, len(f) as nf, len(list_intersect(g, f)) as h from x)
select doc_id, round(case when ng = 0 and nf = 0 then 1.0 when ng = 0 or nf = 0 or h = 0 then 0.0 else 7.25 * (h / nf) * (h / ng) / (6.25 * (h / nf) + h / ng) end, 6) as score from y
""")
def fbeta(t: Tables) -> DataFrame:
    return id_lists(t).select("doc_id", F.round(metrics.f_beta(F.col("gold"), F.col("found")), 6).alias("score"))


@query("AG-12 AG-16 AG-34", f"""
with x as (select quality, toxic, {A} as g, {B} as f from labels), y as (select quality, toxic, case when quality = 1 then 1.0 else 0.5 end as w, len(g) as ng, len(f) as nf, len(list_intersect(g, f)) as h from x), s as (select *, case when ng = 0 and nf = 0 then 1.0 when ng = 0 or nf = 0 or h = 0 then 0.0 else 7.25 * (h / nf) * (h / ng) / (6.25 * (h / nf) + h / ng) end as score from y)
select coalesce(quality, -1) as quality, coalesce(toxic, -1) as toxic, count(*) as n, round(avg(score), 6) as mean, round(sum(score * w) / sum(w), 6) as weighted from s group by grouping sets ((quality), (toxic), ())
""")
def fbeta_by_group(t: Tables) -> DataFrame:
    rows = id_lists(t).withColumn("score", metrics.f_beta(F.col("gold"), F.col("found"))).withColumn("w", F.when(F.col("quality") == 1, 1.0).otherwise(0.5))
    out = rows.groupingSets([["quality"], ["toxic"], []], "quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(metrics.weighted_mean(F.col("score"), F.col("w")), 6).alias("weighted"))
    return out.fillna(-1, ["quality", "toxic"])


@query("AG-13", """
with o as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events)
select event_type, value as percentile, n from o where r = cast(floor((n - 1) * 0.95) as bigint) + 1
""")
def percentile_floor(t: Tables) -> DataFrame:
    return metrics.floor_percentile(t.events, "value", 0.95, ["event_type"])


@query("AG-13", """
with o as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events)
select event_type, value as percentile, n from o where r = cast(round_even((n - 1) * 0.5, 0) as bigint) + 1
""")
def percentile_nearest(t: Tables) -> DataFrame:
    return metrics.floor_percentile(t.events, "value", 0.5, ["event_type"], nearest=True)


@query("AG-24", """
with v as (select user_id as qid, event_type as answer, count(*) as votes, min(event_id) as f from events group by all), r as (select *, cast(sum(votes) over (partition by qid) as bigint) as total, row_number() over (partition by qid order by votes desc, f) as place from v)
select qid, answer, votes, total, case when votes = total then 'high' when votes * 2 > total then 'medium' else 'low' end as confidence from r where place = 1
""")
def majority_vote(t: Tables) -> DataFrame:
    return metrics.majority_vote(t.events.select(F.col("user_id").alias("qid"), F.col("event_type").alias("answer"), F.col("event_id").alias("pos")))


@query("AG-22 ST-8", "select user_id, count(distinct event_type) - 1 as event_type_drift, count(distinct props) - 1 as props_drift from events group by user_id")
def drift_counts(t: Tables) -> DataFrame:
    return metrics.drift(t.events, "user_id", ["event_type", "props"])


@query("AG-23", """
select stage, count(*) as n from (select case when doc_id % 2 = 0 then 'lost_retrieved' when doc_id % 3 = 0 then 'lost_context' when doc_id % 5 = 0 then 'lost_cited' else 'kept' end as stage from labels) group by stage
""")
def funnel(t: Tables) -> DataFrame:
    gold = F.array("doc_id")
    some = lambda k: F.when(F.col("doc_id") % k == 0, F.array(F.lit(-1).cast("long"))).otherwise(gold)
    return t.labels.select(metrics.funnel(gold, [("retrieved", some(2)), ("context", some(3)), ("cited", some(5))]).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("AG-29", """
with a as (select lang as value, count(*) / sum(count(*)) over () as s from documents where doc_id % 2 = 0 group by lang), b as (select lang as value, count(*) / sum(count(*)) over () as s from documents where doc_id % 2 = 1 group by lang)
select coalesce(a.value, b.value) as value, round(coalesce(a.s, 0), 6) as share_a, round(coalesce(b.s, 0), 6) as share_b, round(coalesce(b.s, 0) - coalesce(a.s, 0), 6) as shift from a full outer join b on a.value = b.value
""")
def distribution_shift(t: Tables) -> DataFrame:
    return metrics.shares_shift(t.documents.where("doc_id % 2 = 0"), t.documents.where("doc_id % 2 = 1"), "lang")


@query("AG-31", """
with d as (select l_extendedprice - o_totalprice / 4 as d from lineitem join orders on l_orderkey = o_orderkey), n as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2 as r from d where d <> 0), s as (select count(*) as n, coalesce(sum(case when d > 0 then r end), 0.0) as p, coalesce(sum(case when d < 0 then r end), 0.0) as m from n)
select n, cast(p as double) as w_plus, cast(m as double) as w_minus, round((p - n::double * (n + 1) / 4) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24), 6) as z from s
""")
def wilcoxon(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_extendedprice").alias("a"), (F.col("o_totalprice") / 4).alias("b"))
    return metrics.wilcoxon(rows, "a", "b")


@query("AG-31")
def bootstrap_interval(t: Tables) -> DataFrame:
    return metrics.bootstrap_mean(t.events.select("event_id", "value"), "value", rounds=5000)


@query("", """
with x as (select quality as y, length(text) / 10000.0 as s from labels join documents using (doc_id)), r as (select y, s, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as r from x), c as (select count(*) as n, sum(case when (s >= 0.2) = (y = 1) then 1.0 else 0.0 end) as ok, sum(case when s >= 0.2 and y = 1 then 1 else 0 end) as tp, sum(case when s >= 0.2 and y <> 1 then 1 else 0 end) as fp, sum(case when s < 0.2 and y = 1 then 1 else 0 end) as fn, sum(case when y = 1 then 1 else 0 end) as p, sum(case when y <> 1 then 1 else 0 end) as q, sum(case when y = 1 then r end) as rs from r)
select n, round(ok / n, 6) as accuracy, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((rs - p * (p + 1) / 2) / (p * q), 6) as auroc from c
""")
def binary_metrics(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", (F.length("text") / 10000).alias("s")), "doc_id")
    return metrics.binary_metrics(rows, "quality", "s", 0.2)


@query("WN-11", r"""
with x as (select conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) as n from conversations), y as (select *, cast(sum(n) over (partition by conv_id order by turn) as bigint) as upto from x)
select conv_id, turn, case when upto <= 120 then n when 120 - (upto - n) > 20 then 120 - (upto - n) end as kept from y where upto - n < 120 and (upto <= 120 or 120 - (upto - n) > 20) and n > 0
""")
def context_pack(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", T.tokens(F.col("text")).alias("tokens"))
    return ranking.pack_context(rows, 120, 20, by="conv_id", order="turn").select("conv_id", "turn", F.col("kept").cast("long").alias("kept"))


@query("AG-2 GR-4", """
with s as (select l_orderkey as qid, l_linenumber as page, round(sum(case when l_returnflag = 'R' then 3.0 else 0.8 end), 6) as score from lineitem group by all)
select qid, page, score from (select *, row_number() over (partition by qid order by score desc, page) as place from s) where place <= 2
""", doubles="score")
def evidence_pages(t: Tables) -> DataFrame:
    signals = t.lineitem.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("page"), F.when(F.col("l_returnflag") == "R", 3.0).otherwise(0.8).alias("weight"))
    return grounding.select_pages(grounding.evidence_scores(signals), 2).select("qid", "page", "score")


@query("GR-5", """
with s as (select distinct l_orderkey as qid, l_suppkey % 3 as slot, l_linenumber as page from lineitem), n as (select *, count(*) over (partition by qid, slot) as n from s)
select qid, page, bool_or(n = 1) as necessary from n group by qid, page
""")
def necessary_pages(t: Tables) -> DataFrame:
    return grounding.necessary(t.lineitem.select(F.col("l_orderkey").alias("qid"), (F.col("l_suppkey") % 3).alias("slot"), F.col("l_linenumber").alias("page")))


@query("RR-11 ML-12")
def page_scorer(t: Tables) -> DataFrame:
    text = F.col("text")
    rows = t.labels.join(t.documents, "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.length("text").cast("double").alias("n_chars"), T.token_count(text).cast("double").alias("n_tokens"), T.char_ratio(text, r"[\p{L}]").alias("letters"), metrics.text_noise(text).cast("double").alias("noise"))
    features = ["n_chars", "n_tokens", "letters", "noise"]
    return models.score(models.fit_scorer(rows, features), rows, features).select("doc_id", "label", "score")


@query("ML-14")
def question_clusters(t: Tables) -> DataFrame:
    return models.clusters(t.embeddings)
