"""Strict answers, families, segments, guarantees, mined negatives and reports.

The test tables hold no statutes or judgments, so texts are built from columns;
the SQL knows the columns and not the texts, so it checks what is read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import structure as S, text as T
from tessera.operators import answers, assembly, chunking, metrics, mldata, retrieval as R
from tessera.queries.registry import Tables, query
from tessera.queries.search import BM25, contained, corpus, passages, sparse_hits
from tessera.session import stored
from tessera.sources import files

#: Valid in both dialects.
CLAUSE = """concat('Article ', cast(o_orderkey % 9 + 1 as string), case o_orderkey % 4 when 0 then ': a person shall not sell the goods' when 1 then ': a person may sell the goods' when 2 then ': a person may sell the goods unless a court orders otherwise' else ': the goods are listed' end,
 '. In force on ', cast(o_orderkey % 28 + 1 as string), ' March ', cast(1990 + o_orderkey % 9 as string), '. The claim is USD ', cast(o_orderkey % 50 + 1 as string), ',500', case when o_orderkey % 3 = 0 then ' million' else '' end, ' under Law No. ', cast(o_custkey % 30 as string), '.')"""
CAPTION = "concat('CA 00', cast(o_custkey % 9 + 1 as string), '/2020 Alpha ', cast(o_custkey % 7 as string), ' and Beta v Gamma ', cast(o_custkey % 5 as string), ' Ltd')"
ASKED = """case c_custkey % 15 when 0 then 'What is the claim amount?' when 5 then 'What is the law number?' when 10 then 'What year did it start?' when 1 then 'When did it come into force?' when 6 then 'What date is given?' when 11 then 'Which day is it in force?'
 when 2 then 'Who is the claimant?' when 7 then 'Who is the respondent?' when 12 then 'Who are the claimant and the respondent?' when 3 then 'Who are the claimants?' when 8 then 'Who are the respondents?' when 13 then 'Who is it?'
 when 4 then 'Under Article 1, may a person sell the goods?' when 9 then 'Under Article 2, is it prohibited to sell the goods?' else 'May I?' end"""


@query("DB-10 GR-13", """
with c as (select o_custkey as qid, o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey) as place from orders), q as (select c_custkey as qid, c_custkey % 15 as m from customer), x as (select * from c join q using (qid) where place <= 4),
typed as (select qid, case m when 0 then cast(((k % 50 + 1) * 1000 + 500) * case when k % 3 = 0 then 1000000 else 1 end as varchar) when 5 then cast(qid % 30 as varchar) when 10 then cast(1990 + k % 9 as varchar)
 when 2 then 'Alpha ' || qid % 7 when 7 then 'Gamma ' || qid % 5 || ' Ltd' when 3 then 'Alpha ' || qid % 7 || ', Beta' when 8 then 'Gamma ' || qid % 5 || ' Ltd' else (1990 + k % 9) || '-03-' || lpad(cast(k % 28 + 1 as varchar), 2, '0') end as answer, cast(k as varchar) as cited from x where place = 1 and m in (0, 5, 10, 1, 6, 11, 2, 7, 3, 8)),
signs as (select qid, m, bool_or(k % 4 = 0) as no, bool_or(k % 4 in (1, 2)) as yes, bool_or(k % 4 = 2) as but, string_agg(case when k % 4 <> 3 then cast(k as varchar) end, '|' order by place) as cited from x where m in (4, 9) group by all)
select qid, answer, cited from typed union all select qid, case when (m = 9) = no then 'Yes' else 'No' end, cited from signs where (no or yes) and not (no and yes) and not but
""")
def strict_answers(t: Tables) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in ("number", "date", "name", "names", "boolean")]), (F.col("c_custkey") % 5).cast("int"))
    asked = t.customer.select(F.col("c_custkey").alias("qid"), kind.alias("kind"), F.expr(ASKED).alias("query"))
    rows = t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("id"), F.expr(CAPTION).alias("title"), F.expr(CLAUSE).alias("text"))
    return answers.strict_answers(asked, rows).withColumn("cited", F.array_join("cited", "|"))


OPENING = """case o_orderkey % 10 when 0 then 'This tracked change shows' when 1 then 'ENACTMENT NOTICE of the Regulations' when 2 then 'The consolidated version' when 3 then 'An Amendment Law' when 4 then 'These Regulations apply' when 5 then 'IT IS HEREBY ORDERED that costs of USD 5 be paid' when 6 then 'Judgment of the court'
 when 7 then 'CFI 12/2020 between' when 8 then 'This is Law No. 5 of a year' else 'Other words' end"""


@query("CLS-3 CLS-4 CLS-5", """
with x as (select o_orderkey as id, o_orderkey % 10 as k, o_orderkey % 3 + 1 as page from orders), y as (select *, list_extract(['tracked_changes_amendment', 'enactment_notice', 'consolidated_law', 'amendment_law', 'regulations', 'order', 'judgment', 'order', 'law', 'other'], cast(k + 1 as bigint)) as family from x)
select id, family, case when k in (0, 3) then 'amendment' when k in (2, 4, 8) then 'statute' when k in (5, 6, 7) then 'case' else 'other' end as type, case when k = 7 and page = 1 then 'cover' when k = 1 then 'enactment' when k = 5 then 'operative_order' when k = 8 and page = 1 then 'title' else '' end as page_family from y
""")
def document_families(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 + 1).alias("page"), F.expr(OPENING).alias("text"))
    family = S.document_family(F.lit("A title"), F.col("text"))
    return rows.select("id", family.alias("family"), S.document_type(family).alias("type"), S.page_family(F.col("text"), F.col("page")).alias("page_family"))


LEAD = "concat(case turn % 8 when 0 then 'Which laws mention ' when 1 then 'List all judges in common of ' when 2 then 'How many days after ' when 3 then 'Is it not the same judge as ' when 4 then 'When was the date of issue of ' when 5 then 'What was the outcome of the appeal of ' when 6 then 'Under Article 5 what fine ' else '' end, text)"
FAMILIES = ", ".join(f"case when regexp_matches(q, '{p}') then '{name}' end" for name, p in S.QUESTION_RULES)


@query("CLS-12 CLS-13", rf"""
with x as (select conv_id, turn, lower(trim(regexp_replace({LEAD}, '\s+', ' ', 'g'))) as q from conversations where text is not null)
select conv_id, turn, array_to_string(list_filter([{FAMILIES}], lambda n: n is not null), ',') as families from x
""")
def question_families(t: Tables) -> DataFrame:
    rows = t.conversations.where("text is not null")
    return rows.select("conv_id", "turn", F.array_join(S.question_families(F.expr(LEAD)), ",").alias("families"))


BLOCK = "concat(case o_orderkey % 5 when 0 then concat('Item | Price', chr(10), 'Goods | ', cast(o_custkey as string)) when 1 then concat('Signed by: Jane Doe, Justice on ', cast(o_orderkey % 28 + 1 as string), ' March 2020') when 2 then 'The claimant against the other side' when 3 then 'Issued by the ministry' else 'plain words' end, case when o_orderkey % 2 = 0 then repeat(' more', 30) else '' end)"


@query("CH-8", """
with x as (select o_orderkey as id, o_orderkey % 5 as k, o_orderkey % 2 = 0 as long, o_custkey as c, o_orderkey % 28 + 1 as d from orders)
select id, k < 4 or not long as hard, list_extract(['table', 'signature', 'caption', 'notice', null], cast(k + 1 as bigint)) as kind, case when k = 0 then 'Item;Price/Goods;' || c || case when long then repeat(' more', 30) else '' end end as cells, case when k = 1 then 'Jane Doe, Justice, ' || d || ' March 2020' end as signed from x
""")
def hard_pages(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(BLOCK).alias("text"))
    kind, signed = S.region_kind(F.col("text")), S.signature(F.col("text"))
    cells = F.array_join(F.transform(S.table_rows(F.col("text")), lambda r: F.array_join(r, ";")), "/")
    return rows.select("id", S.is_hard_page(F.col("text")).alias("hard"), kind.alias("kind"), F.when(kind == "table", cells).alias("cells"), F.when(kind == "signature", F.concat_ws(", ", signed["signer"], signed["authority"], signed["date"])).alias("signed"))


PAGE = "concat(case when l_linenumber % 3 = 1 then concat('Article ', cast(l_linenumber as string), ': of ', cast(l_partkey as string), chr(10)) else '' end, 'line of ', cast(l_suppkey as string), chr(10), chr(10), 'and one more')"


@query("JN-2 JN-1 DB-5", """
with x as (select l_orderkey as doc, l_linenumber as page, l_partkey, l_suppkey, sum(case when l_linenumber % 3 = 1 then 1 else 0 end) over (partition by l_orderkey order by l_linenumber) as idx from lineitem)
select doc, cast(idx as bigint) as idx, 'article' as kind, 'Article ' || min(page) as label, max(case when page % 3 = 1 then 'of ' || l_partkey end) as title, min(page) as first_page, max(page) as last_page, count(*) * 2 + sum(case when page % 3 = 1 then 1 else 0 end)::bigint as n_lines from x where idx > 0 group by doc, idx
""")
def segments(t: Tables) -> DataFrame:
    pages = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.expr(PAGE).alias("text"))
    return chunking.segments(pages).drop("text")


HITS = f"with {BM25}, hits as (select qid, id, score, rank, source as doc, id % 4 + 1 as page from sparse join documents on doc_id = id where rank <= 30)"


def paged_hits(t: Tables, k: int) -> DataFrame:
    return sparse_hits(t, k).join(corpus(t).select("id", F.col("source").alias("doc")), "id").withColumn("page", F.col("id") % 4 + 1)


@query("FLT-7 GR-12", HITS + """, opening as (select *, row_number() over (partition by qid, doc order by score desc, id) as n from hits where page = 1), chosen as (select * from hits where rank <= 8), led as (select o.qid, o.id, min(c.rank) as rank, 0 as part from opening o join chosen c on c.qid = o.qid and c.doc = o.doc where n = 1 group by o.qid, o.id),
once as (select qid, id, min(rank * 2 + part) as spot from (select * from led union all select qid, id, rank, 1 from chosen) group by qid, id)
select qid, id, slot from (select *, row_number() over (partition by qid order by spot, id) as slot from once) where slot <= 8
""")
def page_one_first(t: Tables) -> DataFrame:
    hits = paged_hits(t, 30)
    return R.page_one_first(hits.where("rank <= 8"), hits, 8)


@query("FLT-5 GR-7", HITS + ", best as (select qid, max(score) < 12 as retry from hits where rank <= 3 group by qid) select qid, id, score, retry from hits join best using (qid) where (not retry and rank <= 3) or (retry and rank <= 9)")
def gated_retry(t: Tables) -> DataFrame:
    hits = sparse_hits(t, 9)
    return R.retried(hits.where("rank <= 3"), hits, 12.0)


@query("HYB-17", HITS + """, weak as (select qid from hits where rank <= 3 group by qid having max(score) < 12), parts as (select qid, id, 0 as level from hits where rank <= 3 union all select qid, id, 1 from hits where page = 2 and qid in (select qid from weak) union all select qid, id, 2 from hits where rank <= 12 and qid in (select qid from weak))
select qid, id, min(level) as level from parts group by qid, id""")
def escalation(t: Tables) -> DataFrame:
    hits = paged_hits(t, 30)
    return R.escalated(hits.where("rank <= 3"), [hits.where("page = 2"), hits.where("rank <= 12")], 12.0)


@query("HYB-10", f"with {BM25} select qid, id, round(score + case when source in ('src10', 'src11') then 0.15 else 0 end, 6) as score from sparse join documents on doc_id = id where rank <= 10")
def title_boost(t: Tables) -> DataFrame:
    hits = sparse_hits(t).join(corpus(t).select("id", "source"), "id")
    boost = R.title_boost(F.coalesce("source", F.lit("")), F.array(F.lit("Src10"), F.lit("sRC11"), F.lit("src1")))
    return hits.select("qid", "id", F.round(F.col("score") + boost, 6).alias("score"))


@query("HYB-16", HITS + """, placed as (select *, row_number() over (partition by qid, doc order by score desc, id) as own from hits), slots as (select *, row_number() over (partition by qid order by own > 1, score desc, id) as slot from placed)
select qid, doc, id, slot from slots where slot <= 5 or own = 1""")
def one_of_each_reference(t: Tables) -> DataFrame:
    return R.one_of_each(paged_hits(t, 30), 5, "doc").select("qid", "doc", "id", "slot")


@query("HYB-16", "select c_custkey as qid, n_name as ref, trim(regexp_replace('compare ' || case when n_name = a then a else ' ' end || ' with ' || case when n_name = b then b else ' ' end, '\\s+', ' ', 'g')) as query from (select c_custkey, n.n_name as a, m.n_name as b from customer join nation n on c_nationkey = n.n_nationkey join nation m on m.n_nationkey = (c_nationkey + 7) % 25 where not contains(n.n_name, m.n_name) and not contains(m.n_name, n.n_name)) cross join (values (0), (1)) v(i) cross join lateral (select case when i = 0 then a else b end as n_name)")
def per_reference_queries(t: Tables) -> DataFrame:
    names = t.nation.select("n_nationkey", "n_name")
    rows = t.customer.join(names.toDF("k1", "a"), F.col("c_nationkey") == F.col("k1")).join(names.toDF("k2", "b"), (F.col("c_nationkey") + 7) % 25 == F.col("k2")).where("not contains(a, b) and not contains(b, a)")
    return R.per_reference(rows.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("compare "), "a", F.lit(" with "), "b").alias("query"), F.array("a", "b").alias("refs")))


@query("SRC-20", "select count(*) as rows, count(distinct doc_id) as ids, count(*) - count(doc_id) as null_ids, count(*) > 0 and count(*) = count(doc_id) as ok from documents")
def table_health(t: Tables) -> DataFrame:
    return R.health(t.documents, "doc_id")


@query("AG-37", """
with l as (select c_custkey as qid, case when c_custkey % 4 = 0 then [] else [c_custkey % 10, c_custkey % 7] end as gold, 1.0 + c_custkey % 3 as weight, case when c_custkey % 5 = 0 then 'compare' else 'single' end as scope from customer), p as (select o_custkey as qid, list(distinct o_orderkey % 10) as pages from orders group by 1), x as (select l.*, coalesce(pages, []) as pages, case when len(list_intersect(gold, coalesce(pages, []))) > 0 then 1.0 else 0.0 end as hit from l left join p using (qid))
select count(*) as n, round(avg(hit) filter (len(gold) > 0), 6) as hit_rate, round(sum(hit * weight) filter (len(gold) > 0) / sum(weight) filter (len(gold) > 0), 6) as weighted_hit_rate, round(avg(hit) filter (len(gold) > 0 and scope = 'compare'), 6) as compare_hit_rate, round(avg(case when len(pages) = 0 then 1.0 else 0.0 end) filter (len(gold) = 0), 6) as zero_rate, round(avg(len(pages)), 6) as mean_pages,
 round(avg(len(list_intersect(gold, pages)) / len(gold)) filter (len(gold) > 0), 6) as mean_recall from x
""")
def selected_page_metrics(t: Tables) -> DataFrame:
    return metrics.selected_page_metrics(_selected(t), _labelled(t))


def _labelled(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    gold = F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 10, k % 7))
    return t.customer.select(k.alias("qid"), gold.alias("gold"), (1.0 + k % 3).alias("weight"), F.when(k % 5 == 0, "compare").otherwise("single").alias("scope"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"))


def _selected(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_custkey").alias("qid")).agg(F.collect_set(F.col("o_orderkey") % 10).alias("pages"))


@query("AG-37", """
with l as (select c_custkey as qid, [c_custkey % 10, c_custkey % 7] as gold, 's' || c_custkey % 3 as source from customer where c_custkey % 4 <> 0), p as (select o_custkey as qid, list(distinct o_orderkey % 10) as pages from orders group by 1)
select source, count(*) as n, round(avg(case when len(list_intersect(gold, coalesce(pages, []))) > 0 then 1.0 else 0.0 end), 6) as hit_rate from l left join p using (qid) group by source
""")
def hit_rate_by_source(t: Tables) -> DataFrame:
    return metrics.hit_rate_by_source(_selected(t), _labelled(t))


@query("AG-20 AG-25", """
with s as (select c_custkey as qid, unnest([0, 1, 2]) as slot from customer), sp as (select qid, slot, [(qid + slot * 3) % 10, (qid * 2 + slot) % 10] as pages from s), p as (select o_custkey as qid, o_orderkey % 3 as doc, o_orderkey % 10 as page from orders), f as (select qid, list(distinct page) as found, count(distinct page) as n from p group by qid), b as (select qid, max(m) > 2 as broad from (select qid, doc, count(distinct page) as m from p group by qid, doc) group by qid),
x as (select sp.qid, case when len(list_intersect(pages, coalesce(found, []))) > 0 then 1 else 0 end as ok, coalesce(n, 0) as n from sp left join f using (qid))
select x.qid, round(avg(ok), 6) as slot_recall, min(ok) = 1 as complete, min(ok) = 0 and max(n) < 3 as over_pruned, coalesce(max(broad::int), 0) = 1 as overbroad from x left join b using (qid) group by x.qid
""")
def slot_metrics(t: Tables) -> DataFrame:
    predicted = t.orders.select(F.col("o_custkey").alias("qid"), (F.col("o_orderkey") % 3).alias("doc"), (F.col("o_orderkey") % 10).alias("page"))
    k = F.col("qid")
    slots = t.customer.select(F.col("c_custkey").alias("qid"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("slot")).withColumn("pages", F.array((k + F.col("slot") * 3) % 10, (k * 2 + F.col("slot")) % 10))
    return metrics.slot_metrics(predicted, slots)


REPLY = "case o_orderkey % 6 when 0 then 'unknown' when 1 then 'yes' when 2 then 'maybe' when 3 then '12' when 4 then 'twelve' else 'text (cite: a_1)' end"
KIND = "case o_orderkey % 6 when 1 then 'boolean' when 2 then 'boolean' when 3 then 'number' when 4 then 'number' else 'free_text' end"


@query("AG-26", """
with x as (select o_orderkey as id, o_orderkey % 6 as k, o_custkey % 2 as cited, o_custkey % 9 as seconds from orders)
select id, concat_ws(',', case when k = 0 and cited = 1 then 'unanswered_with_pages' end, case when k <> 0 and cited = 0 then 'answered_without_pages' end, case when k in (2, 4) then 'wrong_type' end, case when seconds > 5 then 'slow' end, case when k = 5 then 'citation_left_in' end) as flags,
 case k when 0 then 'unknown' when 1 then 'yes' when 3 then '12' when 5 then 'text' end as answer, case when k in (0, 2, 4) then 0 else cited end as n_pages from x
""")
def answer_anomalies(t: Tables) -> DataFrame:
    pages = F.when(F.col("o_custkey") % 2 == 1, F.array(F.lit("a_1"))).otherwise(F.array().cast("array<string>"))
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(REPLY).alias("answer"), F.expr(KIND).alias("kind"), pages.alias("pages"), (F.col("o_custkey") % 9).alias("seconds"))
    rows = rows.withColumn("flags", metrics.answer_anomalies(F.col("answer"), F.col("kind"), F.col("pages"), F.col("seconds"))).withColumn("r", metrics.repaired(F.col("answer"), F.col("pages"), F.col("flags")))
    return rows.select("id", F.array_join("flags", ",").alias("flags"), F.trim("r.answer").alias("answer"), F.size("r.pages").cast("long").alias("n_pages"))


@query("AG-32", """
with x as (select c_custkey as qid, c_custkey % 3 > 0 as passed, c_custkey % 5 as a, c_custkey % 4 as g, c_custkey % 2 as c from customer), s as (select c_custkey as qid, c_custkey % 2 > 0 as passed, c_custkey % 3 as a, c_custkey % 5 as g, 1 as c from customer where c_custkey % 7 = 0),
y as (select qid, coalesce(s.passed, x.passed) as passed, coalesce(s.a, x.a) as a, coalesce(s.g, x.g) as g, coalesce(s.c, x.c) as c from x left join s using (qid))
select count(*) as cases, round(avg(case when passed then 1.0 else 0.0 end), 6) as pass_rate, round(avg(a), 6) as accuracy, round(avg(g), 6) as grounding, round(avg(c), 6) as clarity from y
""")
def judge_summary(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    cheap = t.customer.select(k.alias("qid"), (k % 3 > 0).alias("passed"), (k % 5).alias("accuracy"), (k % 4).alias("grounding"), (k % 2).alias("clarity"))
    strict = t.customer.where("c_custkey % 7 = 0").select(k.alias("qid"), (k % 2 > 0).alias("passed"), (k % 3).alias("accuracy"), (k % 5).alias("grounding"), F.lit(1).cast("long").alias("clarity"))
    return metrics.judge_summary(cheap, strict)


@query("AG-33", """
select c_custkey as id, round(greatest((0.7 * (c_custkey % 11 / 10.0) + 0.3 * (c_custkey % 6 / 5.0)) * (0.5 + c_custkey % 3 / 4.0) * 0.98131 * (case when c_custkey % 2 = 0 then 1.05 else 0.85 end) - case when c_custkey % 7 = 0 then 0.1 else 0 end - case when c_custkey % 5 = 0 then 0.25 else 0 end, 0), 6) as estimate from customer
""", doubles="estimate")
def composite_estimate(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    estimate = metrics.composite_estimate(k % 11 / 10.0, k % 6 / 5.0, 0.5 + k % 3 / 4.0, F.lit(0.98131), F.when(k % 2 == 0, 1.05).otherwise(0.85), [(k % 7 == 0, 0.1), (k % 5 == 0, 0.25)])
    return t.customer.select(k.alias("id"), estimate.alias("estimate"))


@query("AG-36", """
with x as (select cast(('0x' || substr(md5('7:' || doc_id), 1, 8)) as bigint) % 5 as fold, quality, ln(1 + coalesce(length(text), 0)) as s from labels join documents using (doc_id) where quality is not null),
m as (select f.fold, (avg(case when quality = 1 then s end) + avg(case when quality = 0 then s end)) / 2 as middle, avg(case when quality = 1 then s end) >= avg(case when quality = 0 then s end) as up from (select distinct fold from x) f join x on x.fold <> f.fold group by f.fold)
select fold, count(*) as n, round(avg(case when ((s >= middle) = up) = (quality = 1) then 1.0 else 0.0 end), 6) as accuracy from x join m using (fold) group by fold
""")
def cross_validation(t: Tables) -> DataFrame:
    """The middle between the mean lengths of good and bad texts, fitted on four folds."""
    rows = t.labels.where("quality is not null").join(t.documents.select("doc_id", F.log(1 + F.coalesce(F.length("text"), F.lit(0))).alias("s")), "doc_id")

    def fit(train: DataFrame):
        mean = lambda k: F.avg(F.when(F.col("quality") == k, F.col("s")))
        model = train.agg(((mean(1) + mean(0)) / 2).alias("middle"), (mean(1) >= mean(0)).alias("up"))  # one row
        return lambda test: test.crossJoin(F.broadcast(model)).withColumn("score", F.when((F.col("s") >= F.col("middle")) == F.col("up"), 1.0).otherwise(0.0))

    return metrics.cross_validation(rows, fit, "doc_id", "quality", 5, 0.5).select(F.col("fold").cast("long").alias("fold"), "n", "accuracy")


MINED = f"""with {BM25}, gold as (select distinct item_id as qid, doc_id as page from benchmark b join documents d on contains(d.text, b.text)), s as (select qid, id as page, rank, round(score, 4) as overlap, source from sparse join documents on doc_id = id where rank <= 20),
parts as (select qid, page, 'lexical' as source, round(overlap, 6) as score from s union all select qid, page, 'same_doc', round(overlap + 0.35, 6) from s where source = 'src1' union all select qid, page, 'alias', round(overlap + 0.25, 6) from s where source = 'src2' union all select qid, page, 'embedding', round(1.0 / rank + 0.45, 6) from s union all select qid, page, 'false_positive', 100 from s where rank = 2),
once as (select *, row_number() over (partition by qid, page order by score desc, source) as n from parts where (qid, page) not in (select (qid, page) from gold)), mined as (select qid, page, source, score, row_number() over (partition by qid order by score desc, page) as place from once where n = 1)
"""


def _gold(t: Tables) -> DataFrame:
    return stored(contained(t).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("page")))


def _mined(t: Tables, gold: DataFrame) -> DataFrame:
    s = sparse_hits(t, 20).join(corpus(t).select("id", "source"), "id").select("qid", F.col("id").alias("page"), "rank", "source", F.round("score", 4).alias("overlap"))
    sources = {"lexical": s, "same_doc": s.where("source = 'src1'"), "alias": s.where("source = 'src2'"), "embedding": s.withColumn("overlap", 1 / F.col("rank"))}
    return mldata.mined_negatives(sources, gold, 4, s.where("rank = 2"))


@query("ML-4 ML-6", MINED + "select qid, page, source, score, place from mined where place <= 4", doubles="score")
def mined_negatives(t: Tables) -> DataFrame:
    return _mined(t, _gold(t))


@query("ML-6 ML-5", MINED + "select m.qid, g.page as positive_page, m.page as negative_page, m.source, md5(b.text || d.text || e.text) as digest from mined m join gold g using (qid) join benchmark b on b.item_id = m.qid join documents d on d.doc_id = g.page join documents e on e.doc_id = m.page where place <= 4 and d.text <> '' and e.text <> ''")
def negative_triples(t: Tables) -> DataFrame:
    gold = _gold(t)
    rows = mldata.negative_triples(_mined(t, gold), passages(t), gold, t.documents.select(F.col("doc_id").alias("page"), "text"))
    return rows.select("qid", "positive_page", "negative_page", "source", F.md5(F.concat("query", "positive", "negative")).alias("digest"))


@query("ML-7", """
with r as (select c_custkey as qid, [cast(c_custkey % 40 as varchar), 'n' || c_nationkey] as words, case when c_custkey % 3 = 0 then [] else [c_custkey % 17, c_custkey % 5] end as gold from customer), w as (select qid, unnest(list_distinct(words)) as term from r), p as (select a.qid, b.qid as other, count(*) as shared from w a join w b on a.term = b.term and a.qid <> b.qid group by all),
f as (select p.*, x.gold[1] as page from p join r o on o.qid = p.qid join r x on x.qid = other where len(x.gold) > 0 and not list_contains(o.gold, x.gold[1])), once as (select *, row_number() over (partition by qid, page order by shared desc, other) as n from f)
select qid, other, page from (select *, row_number() over (partition by qid order by shared desc, other, page) as place from once where n = 1) where place <= 2
""")
def confusers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    gold = F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 17, k % 5))
    return mldata.confusers(t.customer.select(k.alias("qid"), F.concat_ws(" ", (k % 40).cast("string"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("query"), gold.alias("gold")))


@query("ML-10", """
select cast(c_custkey as varchar) as sample_id, 'what of ' || c_custkey as text, case when c_custkey % 2 = 0 then 'single' end as scope, cast(c_custkey % 4 + 1 as integer) as budget, 'title,costs' as roles, 2.0 * (c_custkey % 3) as weight, 'internal' as source from customer where c_custkey % 3 > 0
union all select 'x' || n_nationkey, n_name, case when n_nationkey % 2 = 0 then 'compare' end, null, '', 0.35, 'external' from nation where n_nationkey % 2 = 0
""", doubles="weight")
def router_examples(t: Tables) -> DataFrame:
    k, n, none = F.col("c_custkey"), F.col("n_nationkey"), F.array().cast("array<string>")
    inner = t.customer.select(k.alias("sample_id"), F.concat(F.lit(" what  of "), k.cast("string")).alias("text"), F.when(k % 2 == 0, "single").alias("scope"), (k % 4 + 1).cast("int").alias("budget"), F.array(F.lit("title"), F.lit("costs")).alias("roles"), (k % 3).alias("weight"))
    outer = t.nation.select(F.concat(F.lit("x"), n.cast("string")).alias("sample_id"), F.col("n_name").alias("text"), F.when(n % 2 == 0, "compare").alias("scope"), F.lit(None).cast("int").alias("budget"), none.alias("roles"))
    return mldata.router_examples([("internal", inner, 2.0), ("external", outer, 0.35)]).withColumn("roles", F.array_join("roles", ","))


@query("ML-8", """
with f as (select s_suppkey as k, 'Supplier ' || s_suppkey as name, s_nationkey as page from supplier), facts as (select name, 'date' as field, (k % 28 + 1) || ' March 2020' as value, page, k from f union all select name, 'status', case when k % 3 = 0 then 'open' else 'closed' end, page, k from f),
stated as (select case field when 'date' then 'single_field' else 'status' end as family, case field when 'date' then 'date' else 'name' end as kind, case field when 'date' then 'When was ' || name || ' issued?' else 'What is the status of ' || name || '?' end as question, value as answer, page from facts where field = 'date' or k % 3 = 0),
pairs as (select 'compare' as family, 'boolean' as kind, 'Do ' || name || ' and ' || n || ' have the same ' || field || '?' as question, case when value = v then 'Yes' else 'No' end as answer, page from (select *, lead(name) over w as n, lead(value) over w as v from facts window w as (partition by field, page order by name, value)) where n is not null)
select family, kind, question, answer, page from (select *, row_number() over (partition by family order by md5(family || '|' || question || '|' || page)) as r from (select * from stated union select * from pairs)) where r <= 20
""")
def synthetic_questions(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select(F.concat(F.lit("Supplier "), k.cast("string")).alias("name"), F.col("s_nationkey").alias("page"), F.concat((k % 28 + 1).cast("string"), F.lit(" March 2020")).alias("date"), F.when(k % 3 == 0, "open").otherwise("closed").alias("status"))
    facts = rows.select("name", F.inline(F.array(F.struct(F.lit("date").alias("field"), F.col("date").alias("value")), F.struct(F.lit("status").alias("field"), F.col("status").alias("value")))), "page")
    pages = rows.groupBy("page").agg(F.concat_ws(" open ", F.lit(""), F.array_join(F.collect_list("date"), " ")).alias("text"))
    return mldata.synthetic_questions(facts, pages, 20).select("family", "kind", "question", "answer", "page")


@query("SRC-13", r"""
select 'passages' as source_dataset, cast(conv_id as varchar) as sample_id, case when count(*) > 1 then 'multi_passage_support' else 'single_field_single_doc' end as scope_label, 'supported' as support_label, '' as role_label, md5(string_agg(trim('[' || turn || '] ' || coalesce(text, '')), chr(10) || chr(10) order by turn)) as digest from conversations group by conv_id
union all select 'spans', 'b' || item_id, 'single_field_single_doc', case when item_id % 2 = 0 then 'supported' else 'unanswerable' end, 'role ' || item_id, md5(text) from benchmark
union all select 'entailment', 'e' || n_nationkey, 'single_field_single_doc', case n_nationkey % 4 when 0 then 'no' when 1 then 'yes' when 2 then 'open' else 'unknown' end, '', md5(n_name) from nation
union all select 'labelled', 'd' || doc_id, '', '', 'quality' || quality || ',toxic' || toxic, md5(cast(doc_id as varchar)) from labels
""")
def normalised_records(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("turn").alias("id"), F.lit(None).cast("string").alias("doc"), "text")))
    groups = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(turns.alias("passages")).withColumn("question", F.lit("what is said?"))
    spans = t.benchmark.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.concat(F.lit('the "role '), F.col("item_id").cast("string"), F.lit('"')).alias("question"), F.col("text").alias("context"), F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit(" "))).alias("answers"))
    pairs = t.nation.select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("premise"), F.lit("it is so").alias("hypothesis"), (F.col("n_nationkey") % 4).alias("label"))
    marked = t.labels.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("text"), F.array(F.concat(F.lit("toxic"), F.col("toxic").cast("string")), F.concat(F.lit("quality"), F.col("quality").cast("string"))).alias("labels"))
    parts = [files.normalise_passages(groups, "passages", "train"), files.normalise_spans(spans, "spans", "train"), files.normalise_entailment(pairs, "entailment", "train", ("no", "yes", "open")), files.normalise_labelled(marked, "labelled", "train")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("source_dataset", "sample_id", "scope_label", "support_label", "role_label", F.md5("text").alias("digest"))


@query("SRC-26", """
select -2 as place, '| n_name | region |' as line union all select -1, '| --- | --- |' union all select n_nationkey, '| ' || n_name || ' | r\\|' || n_regionkey || ' |' from nation
""".replace("\\\\", "\\"))
def report_lines(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", "n_name", F.concat(F.lit("r|"), F.col("n_regionkey").cast("string")).alias("region"))
    return files.markdown_rows(rows, ["n_name", "region"], "n_nationkey")


@query("TXT-14 TXT-36 DB-9", """
select o_orderkey as id, cast(o_custkey % 30 as varchar) as law, o_orderkey % 9 + 1 as article, lpad(cast(o_custkey % 9 + 1 as varchar), 3, '0') as number, o_custkey % 9 + 1 < 8 as plausible from orders
""")
def notice_fields(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(CLAUSE).alias("text"), F.expr(CAPTION).alias("title"))
    number = F.regexp_extract(T.case_number(F.col("title")), "([0-9]+)/", 1)
    return rows.select("id", F.regexp_extract("text", r"Law No\. ([0-9]+)", 1).alias("law"), F.regexp_extract("text", r"Article ([0-9]+)", 1).cast("long").alias("article"), number.alias("number"), T.plausible_case(T.case_number(F.col("title")), most=7).alias("plausible"))


HEADS = "concat(case o_orderkey % 5 when 0 then concat('Contents', chr(10)) when 1 then 'Issued by the ministry; see Schedule 1' when 2 then 'IT IS HEREBY ORDERED between A and B' when 3 then 'Annex to Law No 3' else 'plain' end, ' ', cast(o_orderkey as string))"


@query("CLS-7", """
with x as (select o_orderkey as id, o_orderkey % 5 as k from orders)
select id, list_extract(['duplicate_or_reference', 'issued_by_authority', 'operative_order', 'schedule', 'plain'], cast(k + 1 as bigint)) as template, list_extract([0.10, 0.95, 0.90, 0.55, 0.40], cast(k + 1 as bigint))::double as officialness, list_extract([0.05, 0.97, 0.92, 0.60, 0.55], cast(k + 1 as bigint))::double as source_prior, case k when 2 then 'captioned_case_file' when 3 then 'issued_law_instrument' else 'other' end as family from x
""")
def page_priors(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(HEADS).alias("text"))
    prior, family = S.page_prior(F.col("text")), S.template_family(S.document_family(F.lit("T"), F.col("text")), F.col("text"))
    return rows.select("id", prior["template"].alias("template"), prior["officialness"].alias("officialness"), prior["source_prior"].alias("source_prior"), family.alias("family"))


@query("WN-8", HITS + ", x as (select *, row_number() over (partition by qid, page order by rank) > 1 as again from hits where rank <= 12) select qid, id, page, row_number() over (partition by qid order by again, rank) as slot from x")
def unique_pages_first(t: Tables) -> DataFrame:
    return assembly.unique_pages_first(paged_hits(t, 12)).select("qid", "id", "page", "slot")


@query("GR-2", HITS + ", m as (select item_id as qid, case item_id % 3 when 0 then 'compare' when 1 then 'all' else 'single' end as mode from benchmark), d as (select qid, doc, round(sum(score), 6) as score from hits group by all), p as (select *, row_number() over (partition by qid order by score desc, doc) as place from d) select qid, doc, place from p join m using (qid) where place <= case mode when 'compare' then 2 when 'all' then 6 else 1 end")
def document_scope(t: Tables) -> DataFrame:
    mode = F.when(F.col("item_id") % 3 == 0, "compare").when(F.col("item_id") % 3 == 1, "all").otherwise("single")
    return assembly.document_scope(paged_hits(t, 30), t.benchmark.select(F.col("item_id").alias("qid"), mode.alias("mode")), {"compare": 2, "all": 6}).select("qid", "doc", "place")


@query("SRC-22", """
with r as (select o_custkey as doc, unnest(['Law ' || o_orderkey % 7, 'old ' || o_orderkey % 3]) as ref from orders), g as (select doc, array_to_string(list_sort(list(distinct ref)), ',') as refs from r group by doc) select o_orderkey as id, refs from orders join g on doc = o_custkey
""")
def document_references(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    chunks = t.orders.select(k.alias("id"), F.col("o_custkey").alias("doc"), F.concat(F.lit("see Law "), (k % 7).cast("string"), F.lit(".")).alias("text"), F.array(F.concat(F.lit("old "), (k % 3).cast("string"))).alias("refs"))
    return assembly.with_references(chunks, "Law [0-9]+").select("id", F.array_join("refs", ",").alias("refs"))


@query("SRC-23", """
with x as (select o_orderkey as id, o_orderkey % 3 as k, o_custkey % 4 as p from orders)
select id as question_id, '{"answer":' || case k when 0 then 'null' when 1 then '"true"' else '"text"' end || ',"sources":' || case when k = 0 then '[]' when p = 0 then '[{"doc":"a","pages":[1]}]' else '[{"doc":"a","pages":[1' || case when p <> 1 then ',' || p else '' end || ']},{"doc":"b","pages":[' || p || ']}]' end || ',"total_ms":' || p * 500 || '}' as payload from x
""")
def submission_rows(t: Tables) -> DataFrame:
    k, p = F.col("o_orderkey") % 3, (F.col("o_custkey") % 4).cast("string")
    pages = F.when(p == "0", F.array(F.lit("a_1"))).otherwise(F.array(F.concat(F.lit("a_"), p), F.concat(F.lit("b_"), p), F.lit("a_1")))
    rows = t.orders.select(F.col("o_orderkey").alias("qid"), F.when(k == 1, "boolean").otherwise("free_text").alias("kind"), F.when(k == 0, "n/a").when(k == 1, "Yes").otherwise("text").alias("answer"), pages.alias("pages"), ((F.col("o_custkey") % 4) / 2).alias("seconds"))
    return assembly.submission(rows)


@query("UDF-2 RR-3", HITS + """, c as (select qid, string_agg('[' || rank || '] ' || id || case when coalesce(doc, '') <> '' then ' | ' || doc else '' end || chr(10) || 'page ' || page, chr(10) || chr(10) order by rank) as context from hits where rank <= 3 group by qid)
select qid, md5('Use only these passages.' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || case when qid % 2 = 0 then 'Answer with a number alone.' else 'Answer in at most 50 words and cite passages by number.' end) as prompt, md5(case when qid % 2 = 0 then 'Find the passage that states the number' || chr(10) else '' end || 'Prefer passages of: r1; r2' || chr(10) || text) as asked from c join benchmark on item_id = qid""")
def prompts(t: Tables) -> DataFrame:
    rows = paged_hits(t, 3).select("qid", F.col("rank").alias("pos"), "id", F.col("doc").alias("title"), F.concat(F.lit(" page "), F.col("page").cast("string")).alias("text"))
    kind = F.when(F.col("qid") % 2 == 0, "number").otherwise("free_text")
    made = assembly.context_text(rows).join(passages(t), "qid")
    return made.select("qid", F.md5(assembly.prompt(F.col("query"), F.col("context"), kind, 50)).alias("prompt"), F.md5(assembly.instructed_query(F.col("query"), kind, F.array(F.lit("r1"), F.lit("r2")))).alias("asked"))


@query("UDF-5 UDF-3", """
with x as (select *, row_number() over (partition by conv_id order by turn) as place, coalesce(text, '') as b from conversations), y as (select *, sum(length(b)) over (partition by conv_id order by place) - length(b) as before from x where place <= 4)
select conv_id as qid, md5(string_agg('--- ' || turn || chr(10) || substr(b, 1, cast(300 - before as bigint)), chr(10) order by place)) as sources from y where before < 300 group by conv_id
""")
def capped_sources(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), F.col("turn").alias("page"), "text")
    return assembly.capped_sources(rows, 4, 300).select("qid", F.md5("sources").alias("sources"))


@query("UDF-3", """
with r as (select o_custkey as qid, list_sort(list(distinct o_orderpriority)) as p from orders group by 1) select qid, 'They are:' || chr(10) || array_to_string(list_transform(range(1, len(p) + 1), lambda i: i || '. ' || trim(p[i])), chr(10)) as answer from r
""")
def numbered_answers(t: Tables) -> DataFrame:
    items = t.orders.groupBy(F.col("o_custkey").alias("qid")).agg(F.array_sort(F.collect_list("o_orderpriority")).alias("p"))
    return items.select("qid", assembly.numbered_list(F.concat(F.col("p"), F.array(F.lit(" "), F.lit(None))), "They are:\n").alias("answer"))


@query("CLS-15", r"""
with x as (select conv_id, turn, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) as names, len(list_distinct(regexp_extract_all(text, '[0-9]+'))) as numbers, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) > 20 as long, len(regexp_extract_all(text, '\?')) > 1 as twice from conversations where text is not null)
select conv_id, turn, names, numbers, (names > 0)::bigint + (numbers > 0)::bigint + long::bigint + twice::bigint as complexity from x
""")
def question_profiles(t: Tables) -> DataFrame:
    p = assembly.profile(F.col("text"), {"names": "[A-Z][a-z]+", "numbers": "[0-9]+"})
    rows = t.conversations.where("text is not null").select("conv_id", "turn", p.alias("p"))
    return rows.select("conv_id", "turn", *[F.col(f"p.{c}").cast("long").alias(c) for c in ("names", "numbers", "complexity")])


@query("RR-4 UDF-6", rf"""
with {BM25}, x as (select qid, id, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]+')) as q, list_distinct(regexp_extract_all(lower(d.text), '[\p{{L}}\p{{N}}]+')) as t from sparse join documents d on doc_id = id join benchmark b on item_id = qid where rank <= 5)
select qid, id, round(len(list_intersect(q, t)) / sqrt(len(q) * len(t)), 6) as rerank from x
""")
def plugged_scorer(t: Tables) -> DataFrame:
    """Any function of query and text; here the cosine of their sets of words."""
    hits = sparse_hits(t, 5).join(corpus(t).select("id", "text"), "id").join(passages(t), "qid")
    words = lambda c: F.array_distinct(T.tokens(c))
    return assembly.rescored(hits, lambda q, x: F.size(F.array_intersect(words(q), words(x))) / F.sqrt(F.size(words(q)) * F.size(words(x)).cast("double"))).select("qid", "id", "rerank")


@query("DEN-2 ST-5", "select doc_id, length(text) as size, md5(text) as digest from documents")
def encoded_texts(t: Tables) -> DataFrame:
    """A plugged encoder sees each different text once."""
    encoder = lambda x: F.struct(F.length(x).cast("long").alias("size"), F.md5(x).alias("digest"))
    return assembly.encoded(t.documents.select("doc_id", "text"), encoder).select("doc_id", "vector.size", "vector.digest")
